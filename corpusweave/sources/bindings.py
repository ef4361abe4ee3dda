"""The driver tables as corpora and telemetry streams.

Each binding is one SQL text that Spark and the checking engine both read, so
both sides start from the same rows. Sizes grow with the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def text_sql(template: str) -> str:
    """SQL for a text with `<<expr>>` holes, without escapes that the engines read apart."""
    pieces = []
    for i, piece in enumerate(re.split(r"<<(.*?)>>", template)):
        if i % 2:
            pieces.append(f"cast({piece} as string)")
            continue
        for part in re.split(r"([\n'])", piece):
            if part:
                pieces.append({"\n": "chr(10)", "'": "chr(39)"}.get(part, f"'{part}'"))
    return "concat(" + ", ".join(pieces) + ")"


FILES = """select concat(source, '/', cast(doc_id as string), '.txt') as path, 'txt' as ext,
  lang as language, text as content, n_chars as size_bytes from documents"""

# One file per supplier with up to two relative imports, some of them broken.
_TARGET = "(s_suppkey * {m} + {p}) % (select count(*) from supplier) + 1"
_IMPORT = text_sql("import { f<<t>> } from '../m<<t % 10>>/s<<t>>';")
IMPORT_CORPUS = f"""select concat('src/m', cast(a.s % 10 as string), '/s', cast(a.s as string), '.ts') as path,
  concat(a.line, chr(10), coalesce(b.line, ''), chr(10),
    case when a.s % 4 = 0 then {text_sql("import fp from 'lodash/fp';")} else '// no external' end,
    chr(10), {text_sql("export function f<<a.s>>(a, b) {")}, chr(10), '  if (a && b) {{ return 1; }}', chr(10), '}}') as content
from (select s, {_IMPORT} as line from (select s_suppkey s, {_TARGET.format(m=7, p=3)} t from supplier) e1 where s <> t) a
left join (select s, {_IMPORT} as line from (select s_suppkey s, {_TARGET.format(m=11, p=5)} t from supplier) e2 where s <> t) b on a.s = b.s"""

_TS = """/* part <<p_name>>
 * block note
 */
import { f<<(k * 7 + 3) % 500>> } from './c<<(k * 7 + 3) % 500>>';
import * as fs from 'fs';
import React, { useState as st, type Ref } from '@types/react/hooks';
const lazy = require('lodash/fp');
// brand <<p_brand>>
export function calc<<k>>(<<case k % 3 when 0 then 'a, b, c, d, e, f' when 1 then 'a' else 'a, b' end>>) {
  if (a > <<p_size>> && b) {
    for (let i = 0; i < 3; i++) {
      <<case when k % 5 = 0 then 'while (b || a) { if (i) { if (a) { do { return 7; } } } }' else 'x += 42;' end>>
    }
  } else if (a ? b : a) { return "<<p_name>> calc<<k>>"; }
  // done if nothing
  return <<p_size>>;
}
class Box<<k>> {
	static make(x) { return x; }
}
const LIMIT_<<k % 9>> = 100;
function tiny<<k>>() { return 42; }
"""
_PY = '''"""
doc <<p_name>>
"""
import os
import numpy as np
from pkg<<k % 11>>.util import helper as h, other
# brand <<p_brand>>
MAX_SIZE = <<p_size>>
class Part<<k>>:
    def cost(self, qty, rate):
        if qty and rate:
            return helper(qty, 42)
        elif rate or qty:
            for i in range(3):
                print("if pkg<<k % 11>>.util", 'data/part<<k % 20>>/x.json')
        return 0

def main<<k>>():
    total = 1
    pkg<<k % 11>>.util.run(total)
    return total
'''
_RS = """//! <<p_name>>
use std::collections::HashMap;
pub use crate::pkg<<k % 11>>::{Alpha, Beta as B};
pub fn run<<k>>(&self, v: i32) -> i32 {
    match v {
        1 => { if v > <<p_size>> || v < 0 { return 1; } }
        _ => {}
    }
    v
}
#[test]
fn test_run<<k>>() {
    assert_eq!(run(1), 1);
    assert!(true);
}
"""
_JS = """import def<<k % 17>> from '../lib/u<<k % 17>>';
const mod = import('./lazy<<k % 7>>');
export async function load<<k>>(url, opts) {
      switch (url) {
            case "a": return 1;
            case 'b': return <<p_size>>;
      }
      try { go(); } catch (e) { return e ? 1 : 2; }
      return userName + user_name + MAX_LIMIT;
}
}
"""

CODE_CORPUS = f"""select concat('proj', cast(k % 7 as string), '/src/d', cast(k % 13 as string), '/c', cast(k as string),
    case k % 4 when 0 then '.ts' when 1 then '.py' when 2 then '.rs' else '.js' end) as path,
  case k % 4 when 0 then {text_sql(_TS)} when 1 then {text_sql(_PY)}
             when 2 then {text_sql(_RS)} else {text_sql(_JS)} end as content
from (select p_partkey as k, p_name, p_brand, p_size from part) p"""

# Statements over several lines, several on one line, and what only looks like one.
_TS_MODULES = """/* import { no } from './no'; */
import {
  f<<k % 19>>,
  g<<k % 7>> as h, // note from x
  type T<<k % 5>>,
} from './m<<k % 50>>';
import './side<<k % 7>>';
export { f<<k % 19>> as default, from } from '../lib/u<<k % 17>>';
export * as ns from './ns<<k % 5>>';
export type { Q<<k % 3>> } from './q';
import D<<k % 4>>, { e } from './d'; import { z<<k>> } from './z';
const s = "import { x } from './string'";
import type {
  Only<<k % 2>>,
} from './types<<k % 9>>';
const m = require(
  './cjs<<k % 6>>'
), t = `
import { y } from './template';
`;
export const v = async () => import('./lazy<<k % 8>>');
"""
_PY_MODULES = '''"""
import no
"""
import os, sys as s<<k % 3>>
from .x<<k % 11>> import (
    a<<k % 7>>, b as c,  # note
    d,
)
from m import n<<k % 5>>  # note
if True: import q<<k % 4>>; from . import z
raise E from e
# import commented
from star import *
'''
_RS_MODULES = """use a<<k % 9>>::{
    b::{c, d as dd}, // x
    e as f<<k % 4>>,
    self,
};
pub(crate) use crate::x::Y<<k % 6>>;
/// use doc::no;
let s = "use x::y;"; fn f<'a>() {}
use std::fmt;
"""
MODULE_CORPUS = f"""select concat('mod', cast(k % 11 as string), '/c', cast(k as string), case k % 3 when 0 then '.ts' when 1 then '.py' else '.rs' end) as path,
  case k % 3 when 0 then {text_sql(_TS_MODULES)} when 1 then {text_sql(_PY_MODULES)} else {text_sql(_RS_MODULES)} end as content
from (select p_partkey as k from part) p"""

_MARKDOWN = """# Guide <<c_custkey>>
See [the part](./docs/p<<c_custkey % 40>>.md#top) and [site](https://example.com/a) or ![pic](img/<<c_custkey % 5>>.png).
## Section <<c_mktsegment>>
[ref]: notes/n<<c_custkey % 30>>.md
### Detail
Write <docs/p<<c_custkey % 40>>.md> or <mailto:x@example.com> or [here](#local).
#### Deep
"""
DOC_CORPUS = f"""select concat('docs/g', cast(c_custkey as string), '.md') as path,
  {text_sql(_MARKDOWN)} as content from customer"""

# Guides beside the import corpus, with links to its files, and some that only look like links.
_GUIDES = """# Guide <<s>>
See [the code](../src/m<<t % 10>>/s<<t>>.ts#top "title") and `[no](../src/m1/s1.ts)` or [![pic](./img.png)](/src/m<<t % 10>>/s<<t>>.ts).
```
[skip](../src/m<<t % 10>>/s<<t>>.ts)
```
[s<<t>>.ts]: ../src/m<<t % 10>>/s<<t>>.ts
<g<<s % 7 + 1>>.md> <https://example.com/src/m1/s1.ts> [here](#local)
"""
GUIDE_CORPUS = f"""select path, content from import_corpus union all select concat('docs/g', cast(s as string), '.md') as path, {text_sql(_GUIDES)} as content
from (select s_suppkey s, {_TARGET.format(m=7, p=3)} t from supplier) g"""

_YAML = """# paths of src/m<<k % 20>>
src/m<<k % 20>>: keep
entry: src/m<<k % 20>>/main.ts # src/m<<k % 20>>/x
items:
  - src/m<<k % 20>>/a.yml
  - plain src
note: m<<k % 20>>

"""
_IGNORE = """# src/m<<k % 20>>/
src/m<<k % 20>>/dist
*.log
m<<k % 20>>
"""
CONFIG_CORPUS = f"""select concat('conf/c', cast(k as string), '.yml') as path, {text_sql(_YAML)} as content
from (select c_custkey k from customer) a
union all
select concat('conf/c', cast(k as string), '/.gitignore') as path, {text_sql(_IGNORE)} as content
from (select c_custkey k from customer) b"""

_PACKAGE = """{"name":"pkg<<k>>","version":"1.<<k % 10>>.0","dependencies":{"pkg<<(k * 7 + 3) % n>>":"^1.<<k % 10>>.0","lodash":"<<case k % 6 when 0 then '*' when 1 then '~4.17' when 2 then '4.17.21' when 3 then 'git+https://x.org/l.git#main' when 4 then '>=4 || 5' else 'https://x.org/l.tgz' end>>"},"devDependencies":{"pkg<<(k * 5 + 1) % n>>":"file:../p","jest":"<<k % 30>>.1"}}"""
_REQUIREMENTS = """# pinned for pkg<<k>>
requests==2.<<k % 31>>.0
pkg<<(k * 3 + 2) % n>>[extra]>=1.<<k % 4>>

flask
numpy~=1.2<<k % 9>>
"""
MANIFESTS = f"""select concat('pkgs/p', cast(k as string), '/package.json') as path, {text_sql(_PACKAGE)} as content
from (select c_custkey k, (select count(*) from customer) n from customer) a
union all
select concat('pkgs/p', cast(k as string), '/requirements.txt') as path, {text_sql(_REQUIREMENTS)} as content
from (select c_custkey k, (select count(*) from customer) n from customer) b"""

_CARGO = """[package]
name = "pkg<<k>>"
[dependencies]
serde = { version = "1.<<k>>", features = ["derive"] }
[dev-dependencies]
local = { path = "../p<<k>>", optional = true }
"""
CARGO_MANIFESTS = f"""select concat('pkgs/p', cast(k as string), '/Cargo.toml') as path, {text_sql(_CARGO)} as content
from (select c_custkey k from customer) a"""

# Tables for targets, dotted keys, lists over lines, comments and strings that look like something else, and broken files.
_CARGO_WIDE = """# [dependencies]
[package]
name = "core<<k>>" # x = 1
description = \"\"\"
no = [ broken
[dependencies]
\"\"\"
[dependencies]
log = "0.<<k % 9>>"
tokio.version = "1.<<k % 4>>"
tokio.features = [
  "full", # "all"
  "rt<<k % 3>>",
]
[dependencies.rand]
git = "https://x.org/r<<k % 5>>.git"
optional = true
[target.'cfg(unix)'.dependencies]
libc = '0.2.<<k % 7>>'
[target."windows<<k % 2>>".dev-dependencies.winapi]
version = "0.3"
[workspace.dependencies]
shared.workspace = true
<<case when k % 9 = 0 then '[build-dependencies' else '[build-dependencies]' end>>
cc = { path = "../cc", features = ["a", "b#<<k % 3>>"], optional = false }
"""
_PYPROJECT = """[project]
name = "proj<<k>>"
dependencies = [
  "requests>=2.<<k % 9>> ; python_version < '3'", # note
  "flask",
]
[project.optional-dependencies]
test = ["pytest==<<k % 8>>"]
[tool.poetry.group.dev<<k % 3>>.dependencies]
black = "^2<<k % 5>>"
<<case when k % 11 = 0 then 'left =' else '[tool.other]' end>>
dependencies = ["not"]
"""
TOML_MANIFESTS = f"""select concat('pkgs/p', cast(k as string), case k % 2 when 0 then '/Cargo.toml' else '/pyproject.toml' end) as path,
  case k % 2 when 0 then {text_sql(_CARGO_WIDE)} else {text_sql(_PYPROJECT)} end as content
from (select c_custkey k from customer) a"""

# Dependency rows without parsing, for the operators that take rows.
DEPENDENCIES = """select concat('pkgs/p', cast(l_suppkey as string), '/package.json') as manifest,
  concat('pkg', cast(l_suppkey as string)) as pkg,
  case l_linenumber % 3 when 0 then 'dependencies' when 1 then 'devDependencies' else 'peerDependencies' end as section,
  concat('pkg', cast((l_partkey * 7) % 300 as string)) as name,
  concat(case l_partkey % 7 when 0 then '^' when 1 then '~' when 2 then '>=' when 3 then 'git+https://h.org/r.git#' when 4 then './' else '' end,
         cast(l_linenumber as string), '.', cast(l_partkey % 9 as string)) as spec,
  l_orderkey * 100000 + l_partkey * 8 + l_linenumber as position
from lineitem"""

REQUESTS = """select event_id as request_id, event_type as plugin, event_type <> 'error' as ok, value as ms, ts from events"""

OPERATIONS = """select event_id as op_id, event_type as op_type, concat('f', cast(user_id % 50 as string)) as path,
  cast(event_id % 3 as int) as priority, ts as created_at, value as wait_s from events"""

PROGRESS = """select cast(user_id as string) as token,
  case event_type when 'signup' then 'begin' when 'purchase' then 'end' else 'report' end as kind,
  concat('task ', cast(event_id as string)) as title, event_type as message, ts, event_id
from events where event_type <> 'error'"""

RUNS = """select concat('proj', cast(o_custkey % 20 as string)) as project, o_orderkey as run_id,
  concat('t', cast(o_orderkey % 37 as string)) as test_name, o_orderstatus <> 'F' as passed,
  case o_orderkey % 3 when 0 then null else o_orderstatus = 'O' end as build_passed,
  cast(floor(o_totalprice) as bigint) as operation_ms, cast(floor(o_totalprice) as bigint) + o_orderkey % 1000 as total_ms
from orders"""

# Planned edits: several plans, files and edit kinds; ranges overlap and repeat.
EDITS = """select concat('plan', cast(o_custkey % 200 as string)) as plan_id,
  concat('src/m', cast(o_orderkey % 10 as string), '/s', cast((o_orderkey * 7) % 400 as string),
    case o_orderkey % 4 when 0 then '.ts' when 1 then '.md' when 2 then '.py' else '.toml' end) as path,
  o_orderkey as edit_no,
  case o_orderkey % 9 when 0 then 'create' when 1 then 'delete' when 2 then 'move' else 'replace' end as edit_type,
  case o_orderkey % 5 when 0 then 'import' when 1 then 'string_literal' when 2 then 'documentation' when 3 then 'comment' else 'configuration' end as category,
  cast(floor(o_totalprice) as bigint) % 97 as line,
  cast(floor(o_totalprice) as bigint) % 9973 as start_off,
  cast(floor(o_totalprice) as bigint) % 9973 + o_custkey % 40 as end_off,
  case o_orderkey % 6 when 0 then './util' when 1 then 'name' when 2 then 'lib/a.ts' when 3 then 'x.py' when 4 then '..' else 'word' end as original_text,
  concat('n', cast(o_orderkey % 3 as string)) as new_text,
  o_orderstatus <> 'P' as valid
from orders"""

BINDINGS = {
    "files": FILES,
    "import_corpus": IMPORT_CORPUS,
    "code_corpus": CODE_CORPUS,
    "module_corpus": MODULE_CORPUS,
    "guide_corpus": GUIDE_CORPUS,
    "doc_corpus": DOC_CORPUS,
    "config_corpus": CONFIG_CORPUS,
    "manifests": MANIFESTS,
    "cargo_manifests": CARGO_MANIFESTS,
    "toml_manifests": TOML_MANIFESTS,
    "dependencies": DEPENDENCIES,
    "requests": REQUESTS,
    "operations": OPERATIONS,
    "progress": PROGRESS,
    "runs": RUNS,
    "edits": EDITS,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its times are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use every core for work that is heavy per row, when the scan has fewer tasks than that.

    A large table has more tasks than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# Bindings whose rows are texts, with the table each is made from.
TEXTS = {
    "files": "documents", "code_corpus": "part", "module_corpus": "part", "doc_corpus": "customer", "config_corpus": "customer",
    "manifests": "customer", "cargo_manifests": "customer", "toml_manifests": "customer",
}


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A binding over the tables of one folder."""
    sql = BINDINGS[name]
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            rows = table(spark, sf_dir, t)
            (spread(rows) if TEXTS.get(name) == t else rows).createOrReplaceTempView(t)
    return spark.sql(sql)


def oracle(body: str, *names: str, recursive: bool = False) -> str:
    """`body` with the named bindings in front, for the checking engine.

    A body that starts with a comma goes on with further named parts.
    """
    parts = ",\n".join(f"{n} as ({BINDINGS[n]})" for n in names)
    return f"with {'recursive ' if recursive else ''}{parts}\n{body}" if parts else body
