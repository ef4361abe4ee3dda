"""Queries over manifests and dependency tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import manifests as m
from ..sources.bindings import bound, oracle


def manifest_rows(spark, sf):
    rows = m.read_manifests(bound(spark, sf, "manifests"))
    return rows.select("manifest", "pkg", "section", "name", "spec", F.array_join("features", ",").alias("features"))


def _read(spark, sf, name, *more):
    rows = m.read_manifests(bound(spark, sf, name))
    return rows.select("manifest", "pkg", "section", "name", "spec", F.array_join("features", ",").alias("features"), "optional", "position", *more)


def cargo_rows(spark, sf):
    return _read(spark, sf, "cargo_manifests")


def toml_rows(spark, sf):
    return _read(spark, sf, "toml_manifests", "error")


def specs(spark, sf):
    rows = m.classify_specs(m.read_manifests(bound(spark, sf, "manifests")))
    return rows.select("manifest", "section", "name", "source_kind", "version", "normalized_version", "git_url", "git_rev",
                       "any_version", "version_range")


def _dependencies(spark, sf):
    return bound(spark, sf, "dependencies")


def first_rows(spark, sf):
    return m.dedupe_dependencies(_dependencies(spark, sf)).select("manifest", "section", "name", "spec", "position")


def _sides(spark, sf):
    d = _dependencies(spark, sf)
    half = F.regexp_extract("pkg", r"(\d+)$", 1).cast("int") % 2
    return d.filter(half == 0), d.filter(half == 1)


def extracted(spark, sf):
    source, target = _sides(spark, sf)
    names = _dependencies(spark, sf).select("name").union(
        _dependencies(spark, sf).select(F.concat("pkg", F.lit("-none")).alias("name")))
    return m.extract_dependencies(names, source, target, "peerDependencies")


def merged(spark, sf):
    source, target = _sides(spark, sf)
    return m.merge_dependencies(source, target, "pkg35", skip=("pkg42",))


def merge_totals(spark, sf):
    source, target = _sides(spark, sf)
    return m.merge_counts(m.merge_dependencies(source, target, "pkg35", skip=("pkg42",)))


def _members(spark, sf):
    d = _dependencies(spark, sf)
    members = d.groupBy(F.col("pkg").alias("workspace"), F.col("name").alias("member")).agg(F.min("position").alias("position"))
    asked = members.filter(F.col("position") % 2 == 0).withColumn("member", F.regexp_replace("member", "pkg(\\d)$", "new$1"))
    return members, asked


def members_added(spark, sf):
    return m.update_members(*_members(spark, sf), action="add")


def members_removed(spark, sf):
    return m.update_members(*_members(spark, sf), action="remove")


KEYS = ", k as (select path, content, regexp_extract(path, 'p([0-9]+)/', 1)::bigint as k, (select count(*) from customer) as n from manifests)"
PARSED = f"""{KEYS}, j as (select * from k where path like '%.json'), r as (select * from k where path like '%.txt'),
  rows as (select path as manifest, 'pkg' || k as pkg, 'dependencies' as section, 'pkg' || ((k * 7 + 3) % n) as name, '^1.' || (k % 10) || '.0' as spec, '' as features from j
    union all select path, 'pkg' || k, 'dependencies', 'lodash', content::json -> 'dependencies' ->> 'lodash', '' from j
    union all select path, 'pkg' || k, 'devDependencies', 'pkg' || ((k * 5 + 1) % n), 'file:../p', '' from j
    union all select path, 'pkg' || k, 'devDependencies', 'jest', (k % 30) || '.1', '' from j
    union all select path, 'p' || k, 'dependencies', 'requests', '2.' || (k % 31) || '.0', '' from r
    union all select path, 'p' || k, 'dependencies', 'pkg' || ((k * 3 + 2) % n), '1.' || (k % 4), 'extra' from r
    union all select path, 'p' || k, 'dependencies', 'flask', '*', '' from r
    union all select path, 'p' || k, 'dependencies', 'numpy', '1.2' || (k % 9), '' from r)"""
SIDES = """, source as (select * from dependencies where regexp_extract(pkg, '([0-9]+)$', 1)::int % 2 = 0), target as (select * from dependencies where regexp_extract(pkg, '([0-9]+)$', 1)::int % 2 = 1)"""
MERGED = f"""{SIDES}, s as (select section, name, arg_min(spec, position) as spec from source group by 1, 2), t as (select section, name, arg_min(spec, position) as spec from target group by 1, 2),
  merged as (select coalesce(t.section, s.section) as section, coalesce(t.name, s.name) as name, coalesce(t.spec, s.spec) as spec,
      case when t.name is null then 'merged' when s.name is null then 'target' else 'conflict' end as origin
    from t full join s on t.section = s.section and t.name = s.name where t.name is not null or s.name not in ('pkg35', 'pkg42'))"""
MEMBERS = """, members as (select pkg as workspace, name as member, min(position) as position from dependencies group by 1, 2),
  asked as (select workspace, regexp_replace(member, 'pkg([0-9])$', 'new\\1') as member, position from members where position % 2 = 0)"""

QUERIES = {
    "read_manifests": (manifest_rows, oracle(f"{PARSED} select * from rows", "manifests")),
    "read_cargo_manifests": (cargo_rows, oracle(f"""{KEYS}, j as (select replace(path, 'package.json', 'Cargo.toml') as manifest, k from k where path like '%.json')
      select manifest, 'pkg' || k as pkg, 'dependencies' as section, 'serde' as name, '1.' || k as spec, 'derive' as features, false as optional, 0::bigint as position from j
      union all select manifest, 'pkg' || k, 'dev-dependencies', 'local', 'path:../p' || k, '', true, 1 from j""", "manifests")),
    "read_toml_manifests": (toml_rows, oracle("""
      , t as (select path, regexp_extract(path, 'p([0-9]+)/', 1)::bigint as k, path like '%Cargo.toml' as cargo from toml_manifests),
      d(cargo, position, section, name, spec, features, optional) as (values
        (true, 0::bigint, 'dependencies', 'log', '0.@9', '', false), (true, 1, 'dependencies', 'tokio', '1.@4', 'full,rt@3', false),
        (true, 2, 'dependencies', 'rand', 'git:https://x.org/r@5.git', '', true), (true, 3, 'target.cfg(unix).dependencies', 'libc', '0.2.@7', '', false),
        (true, 4, 'target.windows@2.dev-dependencies', 'winapi', '0.3', '', false), (true, 5, 'workspace.dependencies', 'shared', '*', '', false),
        (true, 6, 'build-dependencies', 'cc', 'path:../cc', 'a,b#@3', false),
        (false, 0, 'dependencies', 'requests', '>=2.@9 ; python_version < ' || chr(39) || '3' || chr(39), '', false), (false, 1, 'dependencies', 'flask', '*', '', false),
        (false, 2, 'optional.test', 'pytest', '==@8', '', true), (false, 3, 'group.dev@3', 'black', '^2@5', '', false)),
      filled as (select path, k, d.* exclude (cargo), case when cargo then k % 9 = 0 else k % 11 = 0 end as broken,
        list_transform([section, spec, features], lambda x: list_reduce(list_prepend(x, ['2', '3', '4', '5', '7', '8', '9']), lambda a, n: replace(a, '@' || n, (k % n::bigint)::varchar))) as f
        from t join d using (cargo))
      select path as manifest, case when path like '%Cargo.toml' then 'core' else 'proj' end || k as pkg, f[1] as section, name, f[2] as spec, f[3] as features, optional, position, null::varchar as error
      from filled where not broken
      union all select path, null, null, null, null, '', false, null, 'cannot be read: ' || case when cargo then '[build-dependencies' else 'left =' end
      from t where case when cargo then k % 9 = 0 else k % 11 = 0 end""", "toml_manifests")),
    "classify_specs": (specs, oracle(f"""{PARSED},
      c as (select *, case when spec like 'git+%' or contains(spec, '.git') then 'git' when regexp_matches(spec, '^(\\./|\\.\\./|file:|/|https?://)') then 'path' else 'version' end as source_kind,
        regexp_replace(spec, '^[\\^~]*(>=)?', '') as version from rows)
      select manifest, section, name, source_kind, version,
        case len(string_split(version, '.')) when 1 then version || '.0.0' when 2 then version || '.0' else array_to_string(string_split(version, '.')[:3], '.') end as normalized_version,
        case when source_kind = 'git' then replace(string_split(spec, '#')[1], 'git+', '') end as git_url, case when source_kind = 'git' and contains(spec, '#') then string_split(spec, '#')[2] end as git_rev,
        spec in ('*', 'latest', 'x', 'X', '') as any_version, contains(spec, '||') or contains(spec, ' - ') or regexp_matches(spec, '^[\\^~<>]') as version_range from c""", "manifests")),
    "dedupe_dependencies": (first_rows, oracle("""
      , f as (select manifest, section, name, min({'position': position, 'pkg': pkg, 'spec': spec}) as x from dependencies group by 1, 2, 3)
      select manifest, section, name, x.spec as spec, x.position as position from f""", "dependencies")),
    "extract_dependencies": (extracted, oracle(f"""{SIDES}, names as (select name from dependencies union select pkg || '-none' from dependencies),
      s as (select name, min({{'section': section, 'position': position, 'spec': spec}}) as x from source group by 1)
      select names.name, x.section as source_section, x.spec as spec, case when x is null then 'not_found'
        when names.name in (select name from target where section = 'peerDependencies') then 'already_exists' else 'added' end as outcome from names left join s using (name)""", "dependencies")),
    "merge_dependencies": (merged, oracle(f"{MERGED} select * from merged", "dependencies")),
    "merge_counts": (merge_totals, oracle(f"""{MERGED} select section, count(*) filter (origin = 'merged') as merged, count(*) filter (origin = 'conflict') as conflicts from merged group by 1""", "dependencies")),
    "members_added": (members_added, oracle(f"""{MEMBERS}, u as (select workspace, member, 0 as late, position from members union all select workspace, member, 1, position from asked),
      g as (select workspace, member, min(late) = 1 as added, arg_min(position, (late, position)) as position from u group by 1, 2)
      select *, count(*) over (partition by workspace) as after, (select count(*) from members m where m.workspace = g.workspace) as before from g""", "dependencies")),
    "members_removed": (members_removed, oracle(f"""{MEMBERS}, g as (select workspace, member, false as added, position from members m
        where not exists (select 1 from asked a where a.workspace = m.workspace and a.member = m.member))
      select *, count(*) over (partition by workspace) as after, (select count(*) from members m where m.workspace = g.workspace) as before from g""", "dependencies")),
}
