"""Queries of selection, lookups and call graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.operators import calls as C
from harrow.operators import graph as G
from harrow.operators import lookups as L
from harrow.operators import selection as S
from harrow.plans.inputs import K_EVENTS, keyed_events, table


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation calls two others."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n.alias("src"), F.explode(F.array((7 * n + 3) % 25, (3 * n + 1) % 25)).alias("dst"))


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("root"))


def call_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = G.expand(_edges(spark, sf_dir), _roots(spark, sf_dir))
    return d.select("root", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "node", "depth", "is_leaf")


def call_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.paths_to(_edges(spark, sf_dir), _roots(spark, sf_dir), 24).select("root", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "depth")


def last_call_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last path in the order of call sites, which is not that of the callees' numbers."""
    n = F.col("n_nationkey")
    nation = table(spark, sf_dir, "nation")
    name = lambda c: c.cast("string")
    sites = nation.select(name(n).alias("src"), F.posexplode(F.array(name((7 * n + 3) % 25), name((3 * n + 1) % 25))).alias("seq", "dst"), F.lit(None).cast("int").alias("line_number"), F.array().cast("array<string>").alias("callbacks"))
    nodes = nation.select(name(n).alias("id"), name(n).alias("name"), F.lit(None).cast("string").alias("expansion"))
    grown = C.tree(sites, nodes, _roots(spark, sf_dir).select(name(F.col("root")).alias("root")), stop="24")
    return G.last_path(C.first_hits(grown, "24")).select(F.col("root").cast("int").alias("root"), F.array_join("path", ">").alias("path"))


def _down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to greater numbers only, so that some nodes are called by none."""
    return _edges(spark, sf_dir).where("dst > src")


def highest_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.highest_parents(_down(spark, sf_dir), 24)


def macro_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macros, each expanding to another by rules with cycles, and a chain of 50."""
    n = F.col("s_suppkey")
    m = table(spark, sf_dir, "supplier").union(table(spark, sf_dir, "supplier").selectExpr("-s_suppkey", "s_name", "s_nationkey", "s_acctbal")).select(F.concat(F.lit("m"), n.cast("string")).alias("name"), F.when((n < 0) & (n > -50), F.concat(F.lit("m"), (n - 1).cast("string"))).when(n % 4 == 0, F.concat(F.lit("f"), n.cast("string"))).otherwise(F.concat(F.lit("m"), ((3 * n + 2) % 25).cast("string"))).alias("value"))
    return G.expand_macros(m)


def edge_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = keyed_events(spark, sf_dir).select(F.col("event_type").alias("src"), (F.col("user_id") % 20).cast("string").alias("dst"), F.col("k").alias("weight"), (F.col("k") % 5).alias("level"))
    return G.bundle(e)


def mermaid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir).select(F.lpad(F.col("src").cast("string"), 2, "0").alias("src"), F.lpad(F.col("dst").cast("string"), 2, "0").alias("dst"), F.col("src").alias("weight"))
    return G.mermaid(e)


def path_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = G.paths_to(_edges(spark, sf_dir), _roots(spark, sf_dir), 24)
    return G.adjacency(p.select(F.col("root").alias("id"), "path"))


def launch_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = lambda i, cb: F.struct(F.concat(F.lit(f"n{i}_"), (F.col("k") % 4).cast("string")).alias("name"), F.when(cb, "cb").alias("callback"))
    k = F.col("k")
    p = keyed_events(spark, sf_dir).select(F.col("event_id").alias("id"), F.array(node(0, k % 3 == 0), node(1, k % 5 == 0), node(2, k % 2 == 0)).alias("path"))
    types = spark.createDataFrame([("n0_0", "TIMER"), ("n1_0", "SIGNAL"), ("n1_1", "THREAD")], "name string, launch string")
    return G.classify(p, types)


def callback_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    cbs = F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("a"))).when(k % 3 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return G.call_edges(keyed_events(spark, sf_dir).select(F.col("user_id").alias("src"), k.alias("dst"), F.col("event_id").alias("line_number"), cbs.alias("callbacks")))


def _defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    d = keyed_events(spark, sf_dir).select(F.concat(F.lit("f"), k.cast("string")).alias("name"), F.concat(F.lit("file"), (F.col("user_id") % 10).cast("string"), F.lit(".c")).alias("file_name"), (k % 3 == 0).alias("is_static"), F.col("event_id").alias("start_line"), (F.col("event_id") + 5).alias("end_line"))
    return d


def resolved_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = L.latest_definition(_defs(spark, sf_dir)).select("unique_id", "file_name", F.regexp_replace("unique_id", r"^\[.*?\]", "").alias("name"), F.startswith("unique_id", F.lit("[")).alias("is_static"))
    calls = keyed_events(spark, sf_dir).select("event_id", F.concat(F.lit("file"), (F.col("event_id") % 10).cast("string"), F.lit(".c")).alias("file_name"), F.concat(F.lit("f"), F.col("k").cast("string")).alias("callee"))
    return L.resolve_callee(calls, d).select("event_id", "target", "is_external")


def definition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.definition_counts(_defs(spark, sf_dir))


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = keyed_events(spark, sf_dir), F.col("k")
    return e.select(F.col("user_id").alias("item"), F.format_string("ep_%09d", "event_id").alias("episode_id"), F.col("event_id").alias("attempt_no"), (k >= 50).alias("passed"), F.when(k % 7 > 0, F.least(F.lit(100.0), F.col("value"))).alias("coverage_pct"), F.when(k % 5 > 0, k.cast("double")).alias("semantic_score"), (k % 4 == 0).alias("validated"), (k % 3 == 0).alias("ok"))


def unit_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.best_unit(_units(spark, sf_dir), "item")


def stub_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _units(spark, sf_dir)
    return S.first_valid(u, "item").withColumnRenamed("episode_id", "stub").join(S.promoted(u, "item").withColumnRenamed("episode_id", "promoted"), "item", "full")


def backup_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.best_so_far(_units(spark, sf_dir), "item", 40.0).select("item", "attempt_no", "stored")


def oldest_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = keyed_events(spark, sf_dir).select(F.col("user_id").alias("item"), F.format_string("p_%09d", "event_id").alias("path"), F.when(F.col("event_type") == "error", "compile_fix").otherwise("gen").alias("kind"), (F.col("k") % 10).alias("mtime"))
    return S.oldest_prompt(p, "item")


def leaf_first_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("id"), F.when(F.col("s_suppkey") % 5 == 0, "x").otherwise((F.col("s_suppkey") % 7).cast("string")).alias("depth"), F.col("s_suppkey").alias("pos"))
    return S.targets(f, limit=20).select("id", "depth_no", "pos")


def depth_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.depth_batches(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("id"), (F.col("s_suppkey") % 7).cast("string").alias("depth")))


def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_k(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), "event_type", F.struct((-F.col("value")).alias("v"), "event_id"), 5).select("event_type", "event_id", "rank")


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = keyed_events(spark, sf_dir).select("user_id", (F.col("k") % 10).alias("ctx"), "event_id")
    return S.first_seen_index(d, ["user_id"], ["ctx"], "event_id").select("event_id", "index")


def resume_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.resume_at(keyed_events(spark, sf_dir), ["user_id", "event_type"], "k")


def turn_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.turn_numbers(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "turn_no")


def key_or_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    e = keyed_events(spark, sf_dir)
    left = e.select("event_id", F.concat(F.lit("k"), k.cast("string")).alias("function_key"), F.col("user_id").alias("func_id"))
    res = e.select(F.when(k % 2 == 0, F.concat(F.lit("k"), k.cast("string"))).alias("function_key"), F.when(k % 3 == 0, F.col("user_id")).alias("func_id"), F.col("value").alias("coverage"))
    return S.key_or_id(left, res).select("event_id", "coverage")


def suffix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    files = table(spark, sf_dir, "nation").select(F.concat(F.lit("dir"), (n % 5).cast("string"), F.lit("/f"), (n % 6).cast("string"), F.lit(".c")).alias("path")).distinct()
    asked = table(spark, sf_dir, "nation").select(F.when(n % 2 == 0, F.concat(F.lit("f"), (n % 9).cast("string"), F.lit(".c"))).otherwise(F.concat(F.lit("dir"), (n % 5).cast("string"), F.lit("/f"), (n % 6).cast("string"), F.lit(".c"))).alias("source")).distinct()
    return L.unique_suffix(asked, files)


def prefix_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", L.rewrite_prefixes(F.col("url"), [("http://", "web:"), ("http://th", "t:"), ("https://", "web+s:")]).alias("url"))


def layer_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    name = F.when(k % 10 == 0, F.concat(F.lit(".wh.f"), (k % 7).cast("string"))).when((k % 29 == 0) & (F.col("event_id") % 5 == 0), F.lit(".wh..wh..opq")).otherwise(F.concat(F.lit("f"), (k % 7).cast("string")))
    e = keyed_events(spark, sf_dir).select(F.col("event_id").alias("layer"), F.concat(F.lit("d"), (F.col("user_id") % 9).cast("string"), F.lit("/"), name).alias("path"), F.col("event_type").alias("content"))
    return L.overlay(e).select("path", "layer", "content")


def lookups_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("user_id"), F.md5("text").alias("launch"))
    return L.with_default(table(spark, sf_dir, "events").select("event_id", "user_id"), r, "user_id", "launch")


def level_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    lv = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("string").alias("r")).agg(F.array_sort(F.collect_list(n)).alias("ids")).agg(F.map_from_entries(F.collect_list(F.struct("r", "ids"))).alias("function_levels"))
    return L.flatten_levels(lv, table(spark, sf_dir, "nation").select(n.alias("id"), "n_name"))


def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of every fiftieth order, spelt with a letter too much, looked up among those of all orders; every name begins alike."""
    key = F.md5(F.col("o_orderkey").cast("string"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", key.alias("k"))
    asked = o.where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("name"), F.concat(F.lit("order-"), F.left("k", F.lit(16)), F.when(F.col("o_orderkey") % 100 == 0, "x").otherwise(""), F.right("k", F.lit(16))).alias("key"))
    return L.fuzzy(asked, o.select(F.col("o_orderkey").alias("doc"), F.concat(F.lit("order-"), "k").alias("key"))).select("name", "doc", "ratio", "rank")


def makefile_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Makefiles made of orders' line items: definitions that some lines continue."""
    i, p = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    key = F.when(F.col("l_partkey") % 3 == 0, "CFLAGS").when(F.col("l_partkey") % 3 == 1, "LIBS").otherwise("OTHER")
    cont = F.when(F.col("l_suppkey") % 2 == 0, " \\").otherwise("")
    # a line is a definition if it is the first or its predecessor is not continued; the predecessor's state is part of the row
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), i.alias("line_no"), F.concat(key, F.lit(" += -x"), p, cont).alias("line")).groupBy("file", "line_no").agg(F.min("line").alias("line"))
    return S.make_variables(S.continuation_groups(d, "file", "line_no", "line"), "file")


QUERIES = {f.__name__: f for f in (fuzzy_names, call_tree, call_paths, last_call_path, highest_parents, macro_targets, edge_bundles, mermaid_lines, path_adjacency, launch_types, callback_edges, resolved_calls, definition_counts, unit_selection, stub_selection, backup_attempts, oldest_prompts, leaf_first_targets, depth_batches, top_values, first_seen, resume_index, turn_counters, key_or_id, suffix_sources, prefix_rewrites, layer_overlay, lookups_with_default, level_functions, makefile_variables)}

_EDGES = "edges as (select distinct src, dst from (select n_nationkey as src, unnest([(7 * n_nationkey + 3) % 25, (3 * n_nationkey + 1) % 25]) as dst from nation))"


def _walk() -> str:
    return f"""{_EDGES}, walk(root, path, node, depth) as (select n_nationkey, [n_nationkey], n_nationkey, 0 from nation where n_regionkey = 0 union all
      select w.root, list_append(w.path, e.dst), e.dst, w.depth + 1 from walk w join edges e on e.src = w.node where w.node <> 24 and not list_contains(w.path, e.dst))"""


_UNITS = K_EVENTS + """,
units as (select user_id as item, printf('ep_%09d', event_id) as episode_id, event_id as attempt_no, k >= 50 as passed, case when k % 7 > 0 then least(100.0, value) end::double as coverage_pct, case when k % 5 > 0 then k end::double as semantic_score, k % 4 = 0 as validated, k % 3 = 0 as ok from k_events)"""
SQL = {
    "call_tree": f"""with recursive {_EDGES}, tree(root, path, node, depth, is_leaf) as (select n_nationkey, [n_nationkey], n_nationkey, 0, false from nation where n_regionkey = 0 union all
      select t.root, list_append(t.path, e.dst), e.dst, t.depth + 1, list_contains(t.path, e.dst) from tree t join edges e on e.src = t.node where not t.is_leaf) select root, array_to_string(path, '>') as path, node, depth, is_leaf from tree""",
    "call_paths": f"with recursive {_walk()} select root, array_to_string(path, '>') as path, depth from walk where node = 24",
    "last_call_path": """with recursive walk(root, place, path, node) as (select n_nationkey, []::int[], [n_nationkey], n_nationkey from nation where n_regionkey = 0 union all
      select w.root, list_append(w.place, i), list_append(w.path, case i when 0 then (7 * w.node + 3) % 25 else (3 * w.node + 1) % 25 end), case i when 0 then (7 * w.node + 3) % 25 else (3 * w.node + 1) % 25 end
      from walk w, (values (0), (1)) v(i) where w.node <> 24 and not list_contains(w.path, case i when 0 then (7 * w.node + 3) % 25 else (3 * w.node + 1) % 25 end))
      select root, array_to_string(arg_max(path, place), '>') as path from walk where node = 24 group by root""",
    "path_adjacency": f"with recursive {_walk()}, hops as (select path, unnest(range(2, len(path) + 1)) as i from walk where node = 24) select distinct path[i - 1] as src, path[i] as dst, i::int as level from hops",
    "highest_parents": f"with recursive {_EDGES}, down as (select * from edges where dst > src), r(node) as (select src from down where dst = 24 union select d.src from down d join r on d.dst = r.node) select distinct node from r where node not in (select dst from down)",
    "macro_targets": """with recursive s as (select s_suppkey as n from supplier union all select -s_suppkey from supplier), m as (select 'm' || n as name, case when n < 0 and n > -50 then 'm' || (n - 1) when n % 4 = 0 then 'f' || n else 'm' || ((3 * n + 2) % 25) end as value from s),
      c(name, hop, path, depth) as (select name, value, [name], 1 from m union all select c.name, m.value, list_append(c.path, c.hop), c.depth + 1 from c join m on m.name = c.hop where not list_contains(c.path, c.hop))
      select name, arg_max(hop, depth) as target, max(depth) as depth from c group by name""",
    "edge_bundles": f"""with {K_EVENTS}, e as (select event_type as src, (user_id % 20)::varchar as dst, k as weight, k % 5 as level from k_events),
      g as (select src, dst, count(*) as n, max(level) as level, sum(weight)::bigint as s, min(weight)::bigint as lo, max(weight)::bigint as hi, list_sort(list(weight::varchar)) as l from e group by 1, 2)
      select src, dst, n, level, case when n > 6 then s end as total, case when n > 6 then lo end as least, case when n > 6 then hi end as most, case when n > 6 then array_to_string(l[1:30], ', ') end as labels, case when n > 6 then round(least(15.0, 1.5 + 2.0 * log2(n))::decimal(20,8), 4)::double end as width from g""",
    "mermaid_lines": """with e as (select lpad(n_nationkey::varchar, 2, '0') as src, lpad(unnest([(7 * n_nationkey + 3) % 25, (3 * n_nationkey + 1) % 25])::varchar, 2, '0') as dst, n_nationkey as weight from nation),
      i as (select node, 'n' || (row_number() over (order by node) - 1) as id from (select src as node from e union select dst from e))
      select 0 as kind, '' as key, 'flowchart TD' as line union all select 1, node, '    ' || id || '[' || node || ']' from i union all select 2, src || '|' || dst || '|' || weight, '    ' || a.id || ' -->|' || weight || '| ' || b.id from e join i a on a.node = src join i b on b.node = dst""",
    "launch_types": f"""with {K_EVENTS} select event_id as id, case when k % 3 = 0 then case when k % 4 = 0 then 'TIMER' else 'NO DATA' end when k % 5 = 0 then case k % 4 when 0 then 'SIGNAL' when 1 then 'THREAD' else 'NO DATA' end else 'FORK' end as launch_via,
      case when k % 3 = 0 then 'n1_' || (k % 4) when k % 5 = 0 then 'n2_' || (k % 4) else 'main' end as call_function from k_events""",
    "callback_edges": f"with {K_EVENTS} select user_id as src, k as dst, event_id as line_number, unnest(case k % 3 when 0 then ['a'] when 1 then ['a', 'b'] else [null] end::varchar[]) as callback from k_events",
    "resolved_calls": f"""with {K_EVENTS}, defs as (select 'f' || k as name, 'file' || (user_id % 10) || '.c' as file_name, k % 3 = 0 as is_static from k_events)
      select event_id, case when s.name is not null then '[' || e.file || ']' || e.callee else e.callee end as target, s.name is null and g.name is null as is_external
      from (select event_id, 'file' || (event_id % 10) || '.c' as file, 'f' || k as callee from k_events) e left join (select distinct name, file_name from defs where is_static) s on s.name = e.callee and s.file_name = e.file left join (select distinct name from defs where not is_static) g on g.name = e.callee""",
    "definition_counts": f"with {K_EVENTS} select count(*) filter (k % 3 <> 0) as n_global, count(*) filter (k % 3 = 0) as n_static from k_events",
    "unit_selection": f"with {_UNITS} select item, episode_id, passed, coverage_pct, semantic_score from units qualify row_number() over (partition by item order by passed desc, coalesce(coverage_pct, -1) desc, coalesce(semantic_score, -1) desc, episode_id desc) = 1",
    "stub_selection": f"with {_UNITS}, v as (select item, min(episode_id) as stub from units where validated group by 1), p as (select item, min(episode_id) as promoted from units where ok group by 1) select coalesce(v.item, p.item) as item, stub, promoted from v full join p on v.item = p.item",
    "backup_attempts": f"""with {_UNITS}, b as (select *, max(case when coverage_pct >= 40 then coalesce(semantic_score, 0) end) over (partition by item order by attempt_no rows between unbounded preceding and 1 preceding) as best from units)
      select item, attempt_no, coalesce(coverage_pct >= 40 and coalesce(semantic_score, 0) >= coalesce(nullif(best, 0), -1), false) as stored from b""",
    "oldest_prompts": f"with {K_EVENTS} select user_id as item, printf('p_%09d', event_id) as path from k_events qualify row_number() over (partition by user_id order by event_type = 'error', k % 10, event_id) = 1",
    "leaf_first_targets": "select s_name as id, d as depth_no, s_suppkey as pos from (select *, case when s_suppkey % 5 = 0 then 0 else s_suppkey % 7 end::int as d from supplier) order by d desc, s_suppkey limit 20",
    "depth_batches": "select (s_suppkey % 7)::int as batch, count(*) as n, min(s_name) as first_id from supplier group by 1",
    "top_values": "select event_type, event_id, row_number() over (partition by event_type order by value desc, event_id)::int as rank from events qualify rank <= 5",
    "first_seen": f"""with {K_EVENTS}, f as (select user_id, k % 10 as ctx, min(event_id) as first from k_events group by 1, 2), i as (select *, row_number() over (partition by user_id order by first) - 1 as idx from f)
      select event_id, idx::int as index from k_events e join i on i.user_id = e.user_id and i.ctx = e.k % 10""",
    "resume_index": f"with {K_EVENTS} select user_id, event_type, max(k) + 1 as next_index from k_events group by 1, 2",
    "turn_counters": "select conv_id, turn, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding)::bigint as turn_no from conversations",
    "key_or_id": f"""with {K_EVENTS}, r as (select case when k % 2 = 0 then 'k' || k end as function_key, case when k % 3 = 0 then user_id end as func_id, value from k_events)
      select event_id, coalesce(a.v, b.v) as coverage from k_events e left join (select function_key, max(value) as v from r group by 1) a on a.function_key = 'k' || e.k left join (select func_id, max(value) as v from r group by 1) b on b.func_id = e.user_id""",
    "suffix_sources": """with f as (select distinct 'dir' || (n_nationkey % 5) || '/f' || (n_nationkey % 6) || '.c' as path from nation), a as (select distinct case when n_nationkey % 2 = 0 then 'f' || (n_nationkey % 9) || '.c' else 'dir' || (n_nationkey % 5) || '/f' || (n_nationkey % 6) || '.c' end as source from nation),
      m as (select source, count(path) as n, count(*) filter (path = source or ends_with(path, '/' || source)) as ne, max(path) as one, max(path) filter (path = source or ends_with(path, '/' || source)) as e from a left join f on regexp_extract(path, '[^/]*$') = regexp_extract(source, '[^/]*$') group by 1)
      select source, case when n = 1 then one when ne = 1 then e end as path, case when n = 0 then 'missing' when n > 1 and ne <> 1 then 'ambiguous' else 'ok' end as status from m""",
    "prefix_rewrites": "select page_id, replace(replace(replace(url, 'http://th', 't:'), 'https://', 'web+s:'), 'http://', 'web:') as url from pages",
    "layer_overlay": f"""with {K_EVENTS}, e as (select event_id as layer, 'd' || (user_id % 9) || '/' as dir, case when k % 10 = 0 then '.wh.f' || (k % 7) when k % 29 = 0 and event_id % 5 = 0 then '.wh..wh..opq' else 'f' || (k % 7) end as name, event_type as content from k_events),
      last as (select dir || name as path, dir, max(layer) as layer, arg_max(content, layer) as content from e where not starts_with(name, '.wh.') group by 1, 2)
      select path, layer, content from last l where not exists (select 1 from e where starts_with(name, '.wh.f') and e.dir || substr(e.name, 5) = l.path and e.layer > l.layer) and not exists (select 1 from e where name = '.wh..wh..opq' and e.dir = l.dir and e.layer > l.layer)""",
    "lookups_with_default": "select event_id, e.user_id, coalesce(md5(text), 'NO DATA') as launch from events e left join benchmark b on b.item_id = e.user_id",
    "level_functions": "select n_nationkey as id, n_regionkey::varchar as level, n_name from nation",
    "fuzzy_names": "select o_orderkey as name, o_orderkey as doc, case when o_orderkey % 100 = 0 then 76.0 / 77 else 1.0 end::double as ratio, 1 as rank from orders where o_orderkey % 50 = 0",
    "makefile_variables": r"""with l as (select l_orderkey as file, l_linenumber as line_no, min(case l_partkey % 3 when 0 then 'CFLAGS' when 1 then 'LIBS' else 'OTHER' end || ' += -x' || l_partkey || case when l_suppkey % 2 = 0 then ' \' else '' end) as line from lineitem group by 1, 2),
      o as (select *, coalesce(ends_with(lag(line) over (partition by file order by line_no), '\'), false) and starts_with(line, 'OTHER') as open from l), g as (select *, sum(case when open then 0 else 1 end) over (partition by file order by line_no) as g from o),
      b as (select file, g, line_no, case when open then null else split_part(line, ' ', 1) end as key, trim(regexp_replace(case when open then line else split_part(line, '+= ', 2) end, '\\\s*$', ''), ' ') as body from g),
      d as (select file, max(key) as key, min(line_no) as line_no, string_agg(body, ' ' order by line_no) as value from b group by file, g)
      select file, key, string_agg(value, ' ' order by line_no) as value from d where key in ('CFLAGS', 'LIBS') group by 1, 2""",
}
