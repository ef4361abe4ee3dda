"""Reference graphs: neighbours, impact, rewriting, reachability, cycles, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, folder, relative, without_extension
from ..session import pinned
from .chains import PAIRS, Graph, chain_rows

HELD_EDGES, HELD_BYTES = 1 << 21, 1 << 27  # of a graph that a task may hold


def importers(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges into any of `targets(path)`."""
    return edges.join(targets.select(F.col("path").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def imports_of(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Edges out of any of `sources(path)`."""
    return edges.join(sources.select(F.col("path").alias("src")).distinct(), "src", "left_semi").select("src", "dst")


def importers_of_directory(edges: DataFrame, dirs: DataFrame) -> DataFrame:
    """Files that import anything below a folder, per folder of `dirs(dir)`.

    Every target is expanded to its parent folders, which makes the prefix test
    an equi-join.
    """
    below = edges.select("src", F.explode_outer(ancestors(F.col("dst"))).alias("dir"))
    return below.join(dirs.select("dir").distinct(), "dir", "left_semi").select("dir", "src").distinct()


def degree(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Fan-in and fan-out of every file; isolated files have neither."""
    ends = edges.select(F.explode_outer(F.array(
        F.struct(F.col("src").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("dst").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    everything = ends.unionByName(files.select("path", F.lit(0).alias("i"), F.lit(0).alias("o")))
    return everything.groupBy("path").agg(
        F.sum("i").cast("bigint").alias("fan_in"), F.sum("o").cast("bigint").alias("fan_out")).withColumn(
        "isolated", (F.col("fan_in") == 0) & (F.col("fan_out") == 0))


def moved_paths(files: DataFrame, rename_map: DataFrame) -> DataFrame:
    """(old_path, new_path) of every file a map of file and folder renames moves.

    The longest matching old path wins.
    """
    keys = files.select("path", F.explode_outer(F.concat(F.array("path"), ancestors(F.col("path")))).alias("old"))
    hit = keys.join(rename_map.select("old", "new"), "old")
    new_path = F.concat("new", F.substring(F.col("path"), F.length("old") + 1, F.length("path")))
    return hit.groupBy(F.col("path").alias("old_path")).agg(
        F.max_by(new_path, F.length("old")).alias("new_path"))


def rename_impact(edges: DataFrame, files: DataFrame, rename_map: DataFrame) -> DataFrame:
    """Files to touch for a set of renames, without those that move themselves."""
    moved = moved_paths(files, rename_map).select(F.col("old_path").alias("dst"))
    touched = edges.join(moved, "dst", "left_semi").groupBy("src").agg(F.count("*").alias("references"))
    return touched.join(moved.withColumnRenamed("dst", "src"), "src", "left_anti").select(
        F.col("src").alias("path"), "references")


# Endings that imports leave off.
SCRIPT_ENDINGS = ["ts", "tsx", "js", "jsx"]


def new_specifier(importer: Column, target: Column, original: Column) -> Column:
    """Specifier for a moved target: relative from the importer, endings and anchors as usual."""
    drop = target.rlike(r"\.(?:" + "|".join(SCRIPT_ENDINGS) + ")$")
    path = F.when(drop, without_extension(target)).otherwise(target)
    seen = relative(folder(importer), path)
    dotted = F.when(seen.startswith("../") | seen.startswith("./"), seen).otherwise(F.concat(F.lit("./"), seen))
    anchor = F.regexp_extract(original, r"(#[^#]*)$", 1)
    return F.concat(dotted, anchor)


def redirected(resolved: DataFrame, moved: DataFrame) -> DataFrame:
    """Resolved imports that a move changes, with `new_text`: the specifier seen from where the importer ends up.

    `@`, `~` and `$` specifiers keep their prefix and get the new path behind it;
    other bare specifiers stay.
    """
    targets = moved.select(F.col("old_path").alias("target"), F.col("new_path").alias("_to"))
    sources = moved.select(F.col("old_path").alias("path"), F.col("new_path").alias("_from"))
    hit = resolved.filter(F.col("target").isNotNull()).join(targets, "target", "left").join(sources, "path", "left")
    hit = hit.filter(F.col("_to").isNotNull() | F.col("_from").isNotNull())
    spec = F.col("module_path")
    to = F.coalesce(F.col("_to"), F.col("target"))
    importer = F.coalesce(F.col("_from"), F.col("path"))
    is_relative = spec.startswith("./") | spec.startswith("../")
    aliased = spec.rlike("^[@~$]") & F.col("_to").isNotNull()
    alias = F.concat(F.substring_index(spec, "/", 1), F.lit("/"), to)
    fresh = F.when(is_relative, new_specifier(importer, to, spec)).when(aliased, alias)
    return hit.withColumn("new_text", fresh).filter(F.col("new_text") != spec)


def rewrite_references(resolved: DataFrame, moved: DataFrame) -> DataFrame:
    """Edits, by line, that point relative imports at moved files. `relocate.py` has them with places, and those of links."""
    return redirected(resolved, moved).select(
        "path", "line", F.lit("update_import").alias("edit_type"), F.col("module_path").alias("original_text"), "new_text")


def reachable(
    edges: DataFrame, sources: DataFrame, max_depth: int | None = None, per_source: bool = False,
    reverse: bool = False,
) -> DataFrame:
    """Nodes reachable from `sources(path)` with their hop count; sources have 0.

    By default the hop count is to the nearest source, which keeps the result
    at one row per node; `per_source` keeps one row per (source, node). Each
    round joins only the newest nodes and is written to the checkpoint folder,
    so that neither lineage nor work grows with the rounds before it.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    keys = ["source", "path"] if per_source else ["path"]
    steps = pinned(edges.select(F.col(a).alias("path"), F.col(b).alias("_next")).distinct())
    start = sources.select("path").distinct()
    if per_source:
        start = start.select(F.col("path").alias("source"), "path")
    start = pinned(start.select(*keys, F.lit(0).cast("bigint").alias("depth")))
    seen, frontier, depth = start, start, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        others = [k for k in keys if k != "path"]
        reached = frontier.join(steps, "path").select(*others, F.col("_next").alias("path")).distinct()
        fresh = pinned(reached.join(seen, keys, "left_anti").select(
            *keys, F.lit(depth).cast("bigint").alias("depth")))
        if fresh.isEmpty():
            break
        seen, frontier = seen.unionByName(fresh), fresh
    return seen


def has_path(edges: DataFrame, pairs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """`pairs(source, target)` with a flag whether the target can be reached."""
    found = shortest_chain(edges, pairs, max_depth).select("source", "target", F.lit(True).alias("_yes"))
    return pairs.select("source", "target").distinct().join(found, ["source", "target"], "left").select(
        "source", "target", F.coalesce("_yes", F.lit(False)).alias("reachable"))


def shortest_chain(edges: DataFrame, pairs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """For `pairs(source, target)` the path with the fewest hops, first in text order on a tie.

    Searches from both ends of a pair, and a pair is done when the two newest rings meet, so a chain of n hops costs two searches
    of depth n/2. A graph of at most HELD_EDGES edges and HELD_BYTES of names goes to all tasks, which search batches of pairs in memory and
    write chains only; rings of all ends together would have some sqrt(n) rows for each of n nodes. Larger graphs are searched by joins.
    """
    steps = pinned(edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
    pairs = pinned(pairs.select("source", "target").distinct())
    size = steps.agg(F.count("*").alias("edges"), F.sum(F.octet_length(F.col("src").cast("string")) + F.octet_length(F.col("dst").cast("string"))).alias("bytes")).first()
    found = _searched if size.edges <= HELD_EDGES and (size.bytes or 0) <= HELD_BYTES else _joined
    chains = found(steps, pairs.filter(F.col("source") != F.col("target")), max_depth)
    same = pairs.filter(F.col("source") == F.col("target")).select("source", "target", F.array("source").alias("chain"))
    return same.unionByName(chains).select("source", "target", "chain", (F.size("chain") - 1).cast("bigint").alias("hops"))


def _searched(steps: DataFrame, pairs: DataFrame, max_depth: int | None) -> DataFrame:
    """Shortest chains of distinct pairs (source, target), searched in tasks that hold all `steps`."""
    context, kind = steps.sparkSession.sparkContext, steps.schema["src"].dataType.simpleString()
    held = context.broadcast(Graph(steps.toArrow()))
    tasks = max(context.defaultParallelism, pairs.count() // PAIRS + 1)
    dealt = pairs.repartitionByRange(tasks, "source", "target").sortWithinPartitions("source", "target")
    chains = pinned(dealt.mapInArrow(chain_rows(held, max_depth), f"source {kind}, target {kind}, chain array<{kind}>"))
    held.unpersist()
    return chains


def _joined(steps: DataFrame, open_pairs: DataFrame, max_depth: int | None) -> DataFrame:
    """Shortest chains of distinct pairs (source, target) by joins of rings with `steps`.

    Searches from both ends in turn and joins the two newest rings. Each distinct source and target
    is searched once, whatever the number of pairs, and only while a pair with
    it is open. A node keeps the first of its equally short chains.
    """
    found = open_pairs.limit(0).select("source", "target", F.array("source").alias("chain"))

    def ring(column: str) -> DataFrame:
        ends = open_pairs.select(F.col(column).alias("end")).distinct()
        return pinned(ends.select("end", F.col("end").alias("node"), F.array("end").alias("chain")))

    # Per side: the newest ring, all nodes seen, the join column, the next node, and how a chain grows.
    sides = [
        {"ring": ring("source"), "on": "src", "next": "dst", "end": "source"},
        {"ring": ring("target"), "on": "dst", "next": "src", "end": "target"},
    ]
    for side in sides:
        side["seen"] = side["ring"].select("end", "node")
    depth = 0
    while (max_depth is None or depth < max_depth) and not open_pairs.isEmpty():
        side, other = sides[depth % 2], sides[1 - depth % 2]
        depth += 1
        live = side["ring"].join(open_pairs.select(F.col(side["end"]).alias("end")).distinct(), "end", "left_semi")
        onward = F.array(side["next"])
        grown = F.concat("chain", onward) if side["next"] == "dst" else F.concat(onward, "chain")
        reached = live.join(steps, F.col("node") == F.col(side["on"])).select("end", F.col(side["next"]).alias("node"), grown.alias("chain"))
        best = reached.groupBy("end", "node").agg(F.min("chain").alias("chain"))
        fresh = pinned(best.join(side["seen"], ["end", "node"], "left_anti"))
        side["ring"], side["seen"] = fresh, side["seen"].unionByName(fresh.select("end", "node"))
        head = sides[0]["ring"].select(F.col("end").alias("source"), "node", F.col("chain").alias("_head"))
        tail = sides[1]["ring"].select(F.col("end").alias("target"), "node", F.col("chain").alias("_tail"))
        met = open_pairs.join(head, "source").join(tail, ["target", "node"]).select(
            "source", "target", F.concat("_head", F.slice("_tail", F.lit(2), F.size("_tail"))).alias("chain"))
        chains = met.groupBy("source", "target").agg(F.min("chain").alias("chain"))
        # A pair is given up once the search from either of its ends has run dry.
        alive = fresh.select(F.col("end").alias(side["end"])).distinct().withColumn("_alive", F.lit(True))
        state = pinned(open_pairs.join(chains, ["source", "target"], "left").join(alive, side["end"], "left").select(
            "source", "target", "chain", "_alive"))
        found = found.unionByName(state.filter("chain is not null").drop("_alive"))
        open_pairs = state.filter("chain is null and _alive").select("source", "target")
    return found


def _reduced(edges: DataFrame, records: list[DataFrame]) -> DataFrame:
    """Edges (no loops) without dead ends and without chains, which keep all cycles of the others.

    Each round drops nodes without a way in or out, and takes nodes with one way in and one way out, no two of
    them neighbours, out of their chain: pred -> path -> succ becomes pred -> succ, and (path, pred, succ) a row
    of that round's table in `records`. A third of a chain goes per round, so rounds grow with the logarithm of its length.
    """
    while not edges.isEmpty():
        ends = edges.select(F.explode_outer(F.array(
            F.struct(F.col("src").alias("path"), F.lit(None).cast("string").alias("pred"), F.col("dst").alias("succ")),
            F.struct(F.col("dst").alias("path"), F.col("src").alias("pred"), F.lit(None).cast("string").alias("succ")))).alias("e")).select("e.*")
        nodes = ends.groupBy("path").agg(
            F.count("pred").alias("_ins"), F.count("succ").alias("_outs"), F.min("pred").alias("pred"), F.min("succ").alias("succ"))
        ranked = F.struct(F.xxhash64("path", F.lit(len(records))), F.col("path"))
        marked = pinned(nodes.filter("_ins <= 1 and _outs <= 1 or _ins = 0 or _outs = 0").select(
            "path", "pred", "succ", F.when((F.col("_ins") == 1) & (F.col("_outs") == 1), ranked).alias("rank")))
        if marked.isEmpty():
            break
        chain = marked.filter("rank is not null")
        before = chain.select(F.col("path").alias("pred"), F.col("rank").alias("_before"))
        after = chain.select(F.col("path").alias("succ"), F.col("rank").alias("_after"))
        first = chain.join(before, "pred", "left").join(after, "succ", "left").filter(
            F.coalesce(F.col("rank") < F.col("_before"), F.lit(True)) & F.coalesce(F.col("rank") < F.col("_after"), F.lit(True)))
        taken = pinned(first.select("path", "pred", "succ"))
        records.append(taken)
        gone = marked.filter("rank is null").select(F.col("path").alias("_n")).union(taken.select("path"))
        left = edges.join(gone, F.col("src") == F.col("_n"), "left_anti").join(gone, F.col("dst") == F.col("_n"), "left_anti")
        edges = pinned(left.union(taken.filter("pred <> succ").select("pred", "succ")).distinct())
    return edges


def _restored(groups: DataFrame, records: list[DataFrame]) -> DataFrame:
    """`groups(path, label)` with the chain nodes of `records`: those between two nodes of one group, or from a node back to it."""
    for taken in reversed(records):
        one = groups.select(F.col("path").alias("pred"), F.col("label").alias("_p"))
        other = groups.select(F.col("path").alias("succ"), F.col("label").alias("_s"))
        ring = F.col("pred") == F.col("succ")
        found = taken.join(one, "pred", "left").join(other, "succ", "left").filter(ring | (F.col("_p") == F.col("_s")))
        label = F.coalesce("_p", "pred").alias("label")
        own = found.filter("_p is null").select(F.col("pred").alias("path"), label).distinct()
        groups = pinned(groups.unionByName(found.select("path", label)).unionByName(own))
    return groups


def _spread(labels: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """Pull the smallest label along edges a->b until nothing changes."""
    changed = labels
    while True:
        offers = changed.join(edges, changed["path"] == edges[a]).select(
            F.col(b).alias("path"), "label")
        best = offers.groupBy("path").agg(F.min("label").alias("_offer"))
        merged = labels.join(best, "path", "left")
        better = F.coalesce(F.col("_offer") < F.col("label"), F.lit(False))
        merged = pinned(merged.select(
            "path", F.when(better, F.col("_offer")).otherwise(F.col("label")).alias("label"),
            better.alias("_changed")))
        labels = merged.select("path", "label")
        changed = merged.filter("_changed").select("path", "label")
        if changed.isEmpty():
            return labels


def cycles(edges: DataFrame) -> DataFrame:
    """Files that depend on each other, as (cycle, path); `cycle` is the group's first path.

    Self-imports count. Dead ends are dropped and chains contracted, then the
    smallest path spreads forward through what is left; whoever sends its own label back within that
    colour forms a group. Groups are removed and the rest starts over. At the end chain nodes
    come back, last contracted first.
    """
    edges = pinned(edges.select("src", "dst").distinct())
    loops = edges.filter(F.col("src") == F.col("dst")).select(F.col("src").alias("path"))
    records: list[DataFrame] = []
    rest = _reduced(edges.filter(F.col("src") != F.col("dst")), records)
    groups = loops.limit(0).select("path", F.col("path").alias("label"))
    while not rest.isEmpty():
        nodes = rest.select(F.col("src").alias("path")).distinct()
        colours = _spread(nodes.select("path", F.col("path").alias("label")), rest, "src", "dst")
        s = colours.select(F.col("path").alias("src"), F.col("label").alias("_a"))
        d = colours.select(F.col("path").alias("dst"), F.col("label").alias("_b"))
        inside = pinned(rest.join(s, "src").join(d, "dst").filter("_a = _b").select("src", "dst"))
        roots = colours.filter(F.col("path") == F.col("label")).select("path")
        group = pinned(reachable(inside, roots, reverse=True).select("path").join(colours, "path").select("path", "label"))
        sizes = group.groupBy("label").agg(F.count("*").alias("_n")).filter("_n > 1")
        groups = groups.unionByName(group.join(sizes, "label", "left_semi").select("path", "label"))
        done = group.select(F.col("path").alias("_n"))
        rest = _reduced(pinned(
            rest.join(done, F.col("src") == F.col("_n"), "left_anti")
            .join(done, F.col("dst") == F.col("_n"), "left_anti")), records)
    members = _restored(groups, records)
    firsts = members.groupBy("label").agg(F.min("path").alias("cycle"))
    found = members.join(firsts, "label").select("cycle", "path")
    single = loops.select(F.col("path").alias("cycle"), "path")
    return found.unionByName(single.join(found.select("path"), "path", "left_anti").select("cycle", "path"))


def merge_would_cycle(package_edges: DataFrame, candidates: DataFrame, imports: DataFrame) -> DataFrame:
    """For merges of `source` into `target`: does the target already depend on the source?

    Gives the chain target..source and how many of the source's imports name a
    package of the chain (with `_` read as `-`): the modules in the way.
    `imports` has (pkg, module).
    """
    pairs = candidates.select(F.col("target").alias("source"), F.col("source").alias("target"))
    chains = shortest_chain(package_edges, pairs)
    links = chains.select(F.col("target").alias("pkg"), F.col("source").alias("into"),
                          F.explode_outer("chain").alias("_package")).filter(F.col("pkg") != F.col("_package"))
    named = imports.select("pkg", "module", F.replace(
        F.regexp_extract("module", r"^([^:/.]+)", 1), F.lit("_"), F.lit("-")).alias("_package")).distinct()
    offending = links.join(named, ["pkg", "_package"]).groupBy("pkg", "into").agg(
        F.countDistinct("module").alias("offending_modules"))
    found = chains.select(F.col("target").alias("source"), F.col("source").alias("target"), "chain", "hops")
    joined = candidates.select("source", "target").distinct().join(found, ["source", "target"], "left").join(
        offending.select(F.col("pkg").alias("source"), F.col("into").alias("target"), "offending_modules"),
        ["source", "target"], "left")
    return joined.select("source", "target", F.col("chain").isNotNull().alias("would_cycle"), "chain", "hops",
                         F.coalesce("offending_modules", F.lit(0)).cast("bigint").alias("offending_modules"))


def unused_symbols(symbols: DataFrame, uses: DataFrame, roots: tuple[str, ...] = (),
                   occurrences: DataFrame | None = None) -> DataFrame:
    """Exported symbols (path, name) that no other file names in `uses(path, name)`.

    `occurrences(path, name)`, from `symbol_occurrences`, adds names used in the text, such as those behind a namespace import.
    For each name only the number of using files and one of them matter, so a
    name used everywhere is one pre-aggregated row.
    """
    if occurrences is not None:
        uses = uses.select("path", "name").union(occurrences.select("path", "name"))
    by_name = uses.select("name", "path").distinct().groupBy("name").agg(
        F.count("*").alias("_files"), F.min("path").alias("_one"))
    kept = symbols.filter(~F.col("name").isin(*roots)) if roots else symbols
    joined = kept.join(by_name, "name", "left")
    elsewhere = (F.col("_files") > 1) | (F.col("_one") != F.col("path"))
    return joined.filter(~F.coalesce(elsewhere, F.lit(False))).select("path", "name")


def import_cleanup(imports: DataFrame, deleted: DataFrame) -> DataFrame:
    """Edits that take deleted names out of import and re-export lists; the statement goes when nothing is left.

    Lists are those in braces, and those of Python's `from` imports, over as many lines as they take. A name is meant as it stands in the list
    (`a`, `type T`) or by what it is called at its source (`a` in `a as b`). Each statement is edited once, whatever the number
    of names it loses. Offsets make the rows edits for `apply_edits`; a statement that goes takes its newline along where
    it had its lines to itself.
    """
    braces, listed = r"(?s)\{([^{}]*)\}", F.col("import_type") == "python_from_import"
    given = imports.filter(listed | (F.col("import_type").isin("es_module", "type_only", "re_export") & F.col("clause").contains("{")))
    inner = F.when(listed, F.regexp_replace("clause", r"[()]", "")).otherwise(F.regexp_extract("clause", braces, 1))
    items = F.filter(F.transform(F.split(inner, ","), lambda i: F.trim(i)), lambda i: i != "")
    # Written, as both sides of the join below read them and imports are dear to extract.
    lines = pinned(given.select("path", "line", "start_off", "end_off", "statement", "clause", "newline", listed.alias("_python"), items.alias("_items")))
    called = lambda i: F.substring_index(F.regexp_replace(i, r"^type\s+", ""), " as ", 1)
    each = lines.select("path", "start_off", F.explode_outer("_items").alias("item"))
    keys = each.select("path", "start_off", "item", F.explode_outer(F.array_distinct(F.array("item", called(F.col("item"))))).alias("name"))
    gone = keys.join(deleted.select("name").distinct(), "name", "left_semi").groupBy("path", "start_off").agg(
        F.collect_set("item").alias("_gone"))
    df = lines.join(gone, ["path", "start_off"]).withColumn("_left", F.filter("_items", lambda i: ~F.array_contains("_gone", i)))
    statement, left = F.col("statement"), F.array_join("_left", ", ")
    head, tail = F.regexp_extract(statement, r"(?s)^([^{]*\{)", 1), F.regexp_extract(statement, r"(?s)(\}[^{}]*)$", 1)
    default = F.regexp_extract(head, r"(?s)^(.*?)\s*,\s*\{$", 1)
    python = F.concat(F.regexp_extract(statement, r"(?s)^(from.*?\bimport)\b", 1), F.lit(" "), left)
    nothing = F.size("_left") == 0
    empty = nothing & (F.col("_python") | (default == ""))
    text = (F.when(empty, "").when(F.col("_python"), python)
            .when(nothing, F.concat(default, F.lit(" "), F.regexp_replace(tail, r"^\}\s*", "")))
            .otherwise(F.concat(head, F.lit(" "), left, F.lit(" "), tail)))
    return df.select(
        "path", "line", "start_off", (F.col("end_off") + F.when(empty, F.length("newline")).otherwise(0)).alias("end_off"),
        F.when(empty, "delete").otherwise("replace").alias("edit_type"),
        F.when(empty, F.concat(statement, "newline")).otherwise(statement).alias("original_text"), text.alias("new_text"))


def package_edges(dependencies: DataFrame, members: DataFrame) -> DataFrame:
    """Dependencies between packages of the workspace `members(pkg)`."""
    names = members.select(F.col("pkg").alias("name")).distinct()
    return dependencies.join(names, "name", "left_semi").select(
        F.col("pkg").alias("src"), F.col("name").alias("dst")).distinct()
