"""Edit sets: conflicts, de-duplication, application, statistics, plans and gates."""

from __future__ import annotations

import heapq
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import Ordered

# Kinds of edit.
EDIT_TYPES = [
    "rename", "add_import", "remove_import", "update_import", "insert", "delete", "replace",
    "format", "create", "move",
]
FULL_FILE = ("create", "move")


def checked_edits(edits: DataFrame) -> DataFrame:
    """Fail the job on an unknown kind of edit."""
    known = F.col("edit_type").isin(*EDIT_TYPES)
    checked = F.when(known, F.col("edit_type")).otherwise(
        F.raise_error(F.concat(F.lit("unknown edit type: "), F.col("edit_type"))).cast("string"))
    return edits.withColumn("edit_type", checked)


def _span_order() -> list[Column]:
    return [F.col("start_off"), F.col("end_off"), F.col("edit_no")]


def _clusters(edits: DataFrame, keys: list[str]) -> DataFrame:
    """Number the groups of edits connected by overlaps, per file.

    An edit opens a new group when it starts at or behind every end before it.
    Runs over ranges of the sorted edits, so a file may hold most of them.
    """
    rows = Ordered(edits, keys, _span_order()).max_before("_reach", F.col("end_off"))
    opens = F.when(F.col("_reach").isNull() | (F.col("start_off") >= F.col("_reach")), 1).otherwise(0)
    return rows.running_sum({"_cluster": opens.cast("bigint")}).result().drop("_reach")


def overlapping_edits(edits: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Edits in conflict with another edit of their file, each with one edit it meets.

    Ranges are half open, so touching edits do not conflict. One sort finds
    them, split into ranges of (file, start): an edit meets an earlier one exactly when it starts before the
    furthest end so far, and a later one when the next start lies before its
    end. An insert (an empty range) meets the ranges it lies strictly inside. All pairs are never built.
    """
    spans = edits.select(*keys, "edit_no", "start_off", "end_off")
    ordered = Ordered(spans, list(keys), _span_order())
    ordered.max_before("_before", F.struct("end_off", "edit_no"))
    marked = ordered.following("_after", F.struct("start_off", "end_off", "edit_no")).result()
    earlier = F.coalesce(F.col("_before.end_off") > F.col("start_off"), F.lit(False))
    later = F.coalesce(F.col("_after.start_off") < F.col("end_off"), F.lit(False))
    return marked.filter(earlier | later).select(
        *keys, "edit_no", "start_off", "end_off",
        F.when(earlier, F.col("_before.edit_no")).otherwise(F.col("_after.edit_no")).alias("meets"))


class _Kept:
    """Ranges kept so far, by their place in the list; finds the first that a range meets.

    A tree over the sorted offsets: even leaves are offsets, odd ones the gaps between neighbours. A range fills the
    leaves strictly inside it, held by the fewest nodes that make them up; an empty one is a point at its offset, which other empty ranges do not meet.
    Ranges that end before they start are compared one by one.
    """

    def __init__(self, offsets: list[int]):
        self.leaf = {x: 2 * i for i, x in enumerate(offsets)}
        self.size = 1 << (2 * len(offsets)).bit_length()
        self.none = 1 << 62
        # Least place among the ranges that fill a node, and among all that touch its leaves.
        self.over, self.least = [self.none] * (2 * self.size), [self.none] * (2 * self.size)
        self.heaps: dict[int, list[tuple[int, int]]] = {}
        self.ranges: list[tuple] = []
        self.owner: list[int] = []
        self.backward: set[int] = set()

    def _nodes(self, start: int, end: int) -> list[int]:
        """Nodes that a range fills; a point is the negative of its leaf."""
        if start == end:
            return [-(self.leaf[start] + self.size)]
        a, b, nodes = self.leaf[start] + 1 + self.size, self.leaf[end] + self.size, []
        while a < b:
            if a & 1:
                nodes.append(a)
                a += 1
            if b & 1:
                b -= 1
                nodes.append(b)
            a, b = a >> 1, b >> 1
        return nodes

    def _refresh(self, node: int) -> None:
        """The least place in a node after a change, and in the nodes above."""
        heap, at = self.heaps[node], abs(node)
        while heap and self.owner[heap[0][0]] != heap[0][1]:
            heapq.heappop(heap)
        if node > 0:
            self.over[at] = heap[0][0] if heap else self.none
        while at:
            least = self.over[at]
            if at < self.size:
                least = min(least, self.least[2 * at], self.least[2 * at + 1])
            elif self.heaps.get(-at):
                least = min(least, self.heaps[-at][0][0])
            self.least[at], at = least, at >> 1

    def put(self, place: int, edit: int, start: int | None, end: int | None) -> None:
        """`edit` takes `place`, which is new or held by another range."""
        old = self.ranges[place] if place < len(self.ranges) else (None, None)
        if place == len(self.ranges):
            self.ranges.append(old)
            self.owner.append(edit)
        self.owner[place], self.ranges[place] = edit, (start, end)
        self.backward.discard(place)
        if old[0] is not None and old[1] is not None and old[0] <= old[1]:
            for node in self._nodes(*old):
                self._refresh(node)
        if start is None or end is None:
            return
        if start > end:
            self.backward.add(place)
            return
        for node in self._nodes(start, end):
            heapq.heappush(self.heaps.setdefault(node, []), (place, edit))
            self._refresh(node)

    def first_met(self, start: int | None, end: int | None) -> int | None:
        """The first place whose range overlaps (start, end)."""
        if start is None or end is None:
            return None
        if start > end:
            every = ((i, r) for i, r in enumerate(self.ranges) if None not in r)
            return next((i for i, (s, e) in every if s < end and start < e), None)
        over, least, best = self.over, self.least, self.none
        if start == end:
            a = self.leaf[start] + self.size
            while a:
                best, a = min(best, over[a]), a >> 1
        else:
            left, right = self.leaf[start] + 1 + self.size, self.leaf[end] + self.size
            a, b = left, right - 1
            while a:
                if over[a] < best:
                    best = over[a]
                if over[b] < best:
                    best = over[b]
                a, b = a >> 1, b >> 1
                if left < right:
                    if left & 1:
                        if least[left] < best:
                            best = least[left]
                        left += 1
                    if right & 1:
                        right -= 1
                        if least[right] < best:
                            best = least[right]
                    left, right = left >> 1, right >> 1
        for place in self.backward:
            s, e = self.ranges[place]
            if place < best and s < end and start < e:
                best = place
        return best if best < self.none else None


def _survivors(starts: pa.Array, ends: pa.Array, weights: pa.Array) -> pa.Array:
    """For each row the places of the edits that stay, in the order of the list they end up in."""
    rows = []
    for start, end, weight in zip(*(c.to_pylist() for c in (starts, ends, weights))):
        kept = _Kept(sorted({x for x in (*start, *end) if x is not None}))
        for i, (s, e, w) in enumerate(zip(start, end, weight)):
            met = kept.first_met(s, e)
            if met is None:
                kept.put(len(kept.ranges), i, s, e)
                continue
            old = weight[kept.owner[met]]
            if w is not None and old is not None and w > old:
                kept.put(met, i, s, e)
        rows.append(kept.owner)
    return pa.array(rows, pa.list_(pa.int32()))


def dedupe_edits(edits: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Drop repeated edits; of overlapping ones keep the longer original text.

    Edits are taken in `edit_no` order and compared with those kept so far; an
    equal or shorter one is dropped, a longer one takes the place of the first
    it overlaps. Only groups connected by overlaps need that fold, everything
    else passes straight through. The rule is sequential, so a group is folded in one
    task, by a tree over its offsets: n log n steps for n edits.
    """
    keys = list(keys)
    content = [*keys, "start_off", "end_off", "original_text", "new_text"]
    firsts = edits.groupBy(*content).agg(F.min("edit_no").alias("edit_no"))
    marked = _clusters(firsts, keys)
    weight = F.when(F.col("original_text") != "", F.length("original_text")).otherwise(
        F.length("new_text"))
    edit = F.struct("edit_no", "start_off", "end_off", weight.alias("weight"), "original_text",
                    "new_text")
    grouped = marked.groupBy(*keys, "_cluster").agg(F.array_sort(F.collect_list(edit)).alias("_all"))
    # Only numbers go to the fold and back; texts stay in the row.
    folded = F.arrow_udf(_survivors, "array<int>")(*[
        F.col(f"_all.{c}").cast("array<bigint>") for c in ("start_off", "end_off", "weight")])
    single = grouped.filter(F.size("_all") == 1).select(*keys, F.col("_all")[0].alias("e"))
    several = grouped.filter(F.size("_all") > 1).withColumn("_kept", folded).select(
        *keys, F.explode_outer(F.transform("_kept", lambda i: F.get("_all", i))).alias("e"))
    out = single.unionByName(several)
    return out.select(*keys, "e.edit_no", "e.start_off", "e.end_off", "e.original_text", "e.new_text")


APPLIED = (
    "struct<new_content:string,edits:array<struct<edit_no:bigint,reason:string,lines_added:bigint,"
    "lines_removed:bigint,chars_added:bigint,chars_removed:bigint>>>"
)
_REPORT = ("edit_no", "reason", "lines_added", "lines_removed", "chars_added", "chars_removed")
_REPORTS = pa.list_(pa.struct([(n, pa.string() if n == "reason" else pa.int64()) for n in _REPORT]))
# Fixed value: texts held as Python objects at a time, whatever the size of a batch.
_TEXTS = 64


def _applied(text: str | None, items: list[dict]) -> tuple[str, list[tuple]]:
    """A text after its ordered edits, and a report for each; one linear pass."""
    pieces, report, last = [], [], 0
    for e in items:
        start, end = e["start_off"], e["end_off"]
        old, new = e["original_text"] or "", e["new_text"] or ""
        reason = None
        if start is None or end is None or start < 0 or end < start or end > len(text):
            reason = "out of bounds"
        elif start < last:
            reason = "overlaps previous"
        elif old and text[start:end] != old:
            reason = "text differs"
        counts = (0, 0, 0, 0)
        if reason is None:
            pieces += [text[last:start], new]
            breaks = text.count("\n", start, end)
            added = new.count("\n") + (1 if breaks else 0)
            counts = (added, breaks + 1 if breaks else 0, len(new), end - start)
            last = end
        report.append((e["edit_no"], reason, *counts))
    return "".join([*pieces, text[last:]]), report


def _apply(content: pa.Array, edits: pa.Array) -> pa.Array:
    """Apply each row's ordered edits to its text, a few texts at a time."""
    texts, reports = [pa.array([], pa.string())], [pa.array([], _REPORTS)]
    for at in range(0, len(content), _TEXTS):
        done = [_applied(*row) for row in zip(content.slice(at, _TEXTS).to_pylist(), edits.slice(at, _TEXTS).to_pylist())]
        texts.append(pa.array([d[0] for d in done], pa.string()))
        reports.append(pa.array([[dict(zip(_REPORT, r)) for r in d[1]] for d in done], _REPORTS))
    return pa.StructArray.from_arrays([pa.concat_arrays(texts), pa.concat_arrays(reports)], ["new_content", "edits"])


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """Files with their edits applied: path, content, new_content and one report per edit.

    Taken in offset order, an edit is skipped when it is out of bounds, starts
    inside the one applied before it, or names an original text that is not
    there. The fold is sequential by nature, so it runs in Arrow batches.
    """
    edit = F.struct("start_off", "edit_no", "end_off", "original_text", "new_text")
    per_file = edits.groupBy("path").agg(F.array_sort(F.collect_list(edit)).alias("_edits"))
    df = files.select("path", "content").join(per_file, "path")
    df = df.withColumn("_done", F.arrow_udf(_apply, APPLIED)("content", "_edits"))
    return df.select("path", "content", F.col("_done.new_content").alias("new_content"),
                     F.col("_done.edits").alias("edits"))


def edit_reports(applied: DataFrame) -> DataFrame:
    """One row per edit of `apply_edits`; a null reason means applied."""
    return applied.select("path", F.explode_outer("edits").alias("e")).select("path", "e.*")


def edit_statistics(reports: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Edits in total, applied and skipped, lines and characters added and removed."""
    done = F.col("reason").isNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return reports.groupBy(*keys).agg(
        F.count("*").alias("total_edits"),
        F.count_if(done).alias("applied"),
        F.count_if(~done).alias("skipped"),
        total("lines_added"), total("lines_removed"), total("chars_added"), total("chars_removed"))


def merge_plans(*plans: DataFrame, plan_id: str = "merged") -> DataFrame:
    """One plan out of several; of several full-file edits of a path the first stays.

    `apply_order` counts bottom-up per file, so that applying an edit leaves
    the offsets of the ones after it intact.
    """
    tagged = [p.withColumn("_plan", F.lit(i)) for i, p in enumerate(plans)]
    union = reduce(lambda a, b: a.unionByName(b), tagged)
    full = F.col("edit_type").isin(*FULL_FILE)
    # A grouped minimum instead of a window: it is pre-aggregated per task.
    first = union.filter(full).groupBy("path", "edit_type").agg(
        F.min(F.struct("_plan", "edit_no")).alias("_first")).select(
        "path", "edit_type", F.col("_first._plan").alias("_plan"), F.col("_first.edit_no").alias("edit_no"))
    kept_full = union.filter(full).join(first, ["path", "edit_type", "_plan", "edit_no"], "left_semi")
    merged = union.filter(~full).unionByName(kept_full)
    order = [F.col("start_off").desc(), F.col("_plan"), F.col("edit_no")]
    ranked = Ordered(merged, ["path"], order).row_number("apply_order").result()
    return ranked.withColumn("plan_id", F.lit(plan_id)).drop("_plan")


def plan_preview(edits: DataFrame) -> DataFrame:
    """Files created, modified and deleted, and edits, per plan.

    Counts come from one row per (plan, path), so no set of paths is collected.
    """
    per_path = edits.groupBy("plan_id", "path").agg(
        F.bool_or(F.col("edit_type") == "create").alias("_created"),
        F.bool_or(F.col("edit_type").isin("replace", "move")).alias("_modified"),
        F.bool_or(F.col("edit_type") == "delete").alias("_deleted"),
        F.count("*").alias("_edits"))
    return per_path.groupBy("plan_id").agg(
        F.count_if("_created").alias("created_files"),
        F.count_if("_modified").alias("modified_files"),
        F.count_if("_deleted").alias("deleted_files"),
        F.count("*").alias("files"),
        F.sum("_edits").alias("edits"))


def plan_files(edits: DataFrame) -> DataFrame:
    """The file sets behind `plan_preview`: one row per plan, path and what happens to it."""
    kind = F.when(F.col("edit_type") == "create", "created").when(
        F.col("edit_type") == "delete", "deleted").when(F.col("edit_type").isin("replace", "move"), "modified")
    return edits.select("plan_id", "path", kind.alias("change")).filter(F.col("change").isNotNull()).distinct()


def impact_level(edits: DataFrame, categories: tuple[str, ...] = ()) -> DataFrame:
    """low up to 3 files, medium up to 10, else high; with edits per category if named."""
    by_category = [F.count_if(F.col("category") == c).alias(f"_{c}") for c in categories]
    per_path = edits.groupBy("plan_id", "path").agg(F.count("*").alias("_edits"), *by_category)
    sums = [F.sum(f"_{c}").alias(c) for c in categories]
    files = F.count("*")
    level = F.when(files <= 3, "low").when(files <= 10, "medium").otherwise("high")
    return per_path.groupBy("plan_id").agg(files.alias("files"), level.alias("impact"), *sums)


# Endings of code files whose edits may touch an import path.
CODE_ENDINGS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".rs", ".py", ".go", ".java"]
# Endings that make an edited text look like a path.
PATH_ENDINGS = [".js", ".ts", ".tsx", ".jsx", ".mjs", ".rs", ".py"]


def _ends(text: Column, endings: list[str]) -> Column:
    return text.rlike("(?:" + "|".join(e.replace(".", "\\.") for e in endings) + ")$")


def path_edit_warnings(edits: DataFrame) -> DataFrame:
    """The first edit per code file whose original text looks like part of a path."""
    text = F.col("original_text")
    looks = text.contains("/") | text.contains("\\") | text.startswith(".") | _ends(text, PATH_ENDINGS)
    risky = edits.filter(_ends(F.col("path"), CODE_ENDINGS) & looks)
    first = F.min(F.struct("line", "edit_no", "original_text")).alias("f")
    return risky.groupBy("path").agg(first).select(
        "path", "f.line", "f.edit_no", "f.original_text", F.lit("PATH_EDIT").alias("code"))


def atomic_plan_gate(edits: DataFrame) -> DataFrame:
    """Edits of the plans in which every edit is valid.

    Failing plans are found by aggregation and removed by an anti join: a plan
    with a third of all edits is not pulled into one window.
    """
    failing = edits.filter(~F.coalesce(F.col("valid"), F.lit(False))).select("plan_id").distinct()
    return edits.join(failing, "plan_id", "left_anti")


def stale_plans(plan_checksums: DataFrame, files: DataFrame) -> DataFrame:
    """Plan files that changed (`modified`) or vanished (`missing`) since planning.

    Takes a stored `sha256` column where the files have one, so the content is
    not read again.
    """
    current = files.select("path", (F.col("sha256") if "sha256" in files.columns
                                    else F.sha2(F.col("content"), 256)).alias("_now"))
    joined = plan_checksums.join(current, "path", "left")
    state = F.when(F.col("_now").isNull(), "missing").when(
        F.col("_now") != F.col("sha256"), "modified")
    return joined.select("plan_id", "path", state.alias("state")).filter(F.col("state").isNotNull())


def plan_overlap(edits: DataFrame, plan_a: str, plan_b: str) -> DataFrame:
    """Files that two plans both touch."""
    a = edits.filter(F.col("plan_id") == plan_a).select("path")
    return a.intersect(edits.filter(F.col("plan_id") == plan_b).select("path"))


def contested_files(edits: DataFrame) -> DataFrame:
    """Files that several plans touch, with the number of plans: `plan_overlap` for all plans.

    The plans of a file are counted, not paired with each other.
    """
    per_plan = edits.select("path", "plan_id").distinct()
    return per_plan.groupBy("path").agg(F.count("*").alias("plans")).filter(F.col("plans") > 1)
