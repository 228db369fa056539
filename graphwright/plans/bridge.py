"""Graph operators over the star tables and text tables: one query an operator, each with its SQL.

nodes: region project, nation scene, customer scene_node, supplier autoload, part property, orders
method. edges: containment and calls of the parser, references of the resolver. refs: line items
that name a part by ever more exact keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphwright.functions import text as T
from graphwright.operators import graph as G
from graphwright.operators import relational as R

NODES = (("region", "project", "r_regionkey", "r_name"), ("nation", "scene", "n_nationkey", "n_name"), ("customer", "scene_node", "c_custkey", "c_name"), ("supplier", "autoload", "s_suppkey", "s_name"), ("part", "property", "p_partkey", "p_name"), ("orders", "method", "o_orderkey", None))
EDGES = (("contains", "region", "r_regionkey", "nation", "n_nationkey", "nation", "n_regionkey"), ("contains", "nation", "n_nationkey", "customer", "c_custkey", "customer", "c_nationkey"), ("contains", "nation", "n_nationkey", "supplier", "s_suppkey", "supplier", "s_nationkey"), ("calls", "customer", "c_custkey", "orders", "o_orderkey", "orders", "o_custkey"))
KIND = {t: k for t, k, _, _ in NODES}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for t, kind, key, name in NODES:
        k = F.col(key).cast("string")
        parts.append(table(spark, d, t).select(F.concat(F.lit(f"{kind}:"), k).alias("id"), F.lit(kind).alias("kind"), (F.col(name) if name else k).alias("name"), F.concat(F.lit(f"{t}."), k).alias("qualified_name"), F.concat(F.lit(f"res://{t}/"), (F.col(key) % 16).cast("string"), F.lit(".tres")).alias("file_path"), F.col(key).cast("long").alias("start_line")))
    return reduce(DataFrame.unionAll, parts)


def edges(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for kind, t1, _, t2, key2, holder, key1 in EDGES:
        parts.append(table(spark, d, holder).select(F.concat(F.lit(KIND[t1] + ":"), F.col(key1).cast("string")).alias("source"), F.concat(F.lit(KIND[t2] + ":"), F.col(key2).cast("string")).alias("target"), F.lit(kind).alias("kind"), F.lit("resource-parser").alias("provenance")))
    items = table(spark, d, "lineitem")
    for kind, t2, key2 in (("references_symbol", "part", "l_partkey"), ("uses_autoload", "supplier", "l_suppkey")):
        parts.append(items.select(F.concat(F.lit("method:"), F.col("l_orderkey").cast("string")).alias("source"), F.concat(F.lit(KIND[t2] + ":"), F.col(key2).cast("string")).alias("target"), F.lit(kind).alias("kind"), F.lit("resolver").alias("provenance")).distinct())
    return reduce(DataFrame.unionAll, parts)


SQL_NODES = "nodes as (" + " union all ".join(f"select '{k}:' || {key} as id, '{k}' as kind, {name or key + '::varchar'} as name, '{t}.' || {key} as qualified_name, 'res://{t}/' || ({key} % 16) || '.tres' as file_path, {key}::bigint as start_line from {t}" for t, k, key, name in NODES) + ")"
SQL_EDGES = "edges as (" + " union all ".join(f"select '{KIND[t1]}:' || {key1} as source, '{KIND[t2]}:' || {key2} as target, '{kind}' as kind, 'resource-parser' as provenance from {holder}" for kind, t1, _, t2, key2, holder, key1 in EDGES) + " union all select distinct 'method:' || l_orderkey, 'property:' || l_partkey, 'references_symbol', 'resolver' from lineitem union all select distinct 'method:' || l_orderkey, 'autoload:' || l_suppkey, 'uses_autoload', 'resolver' from lineitem)"


def _case_sql(column: str, values: dict[str, int], otherwise: int) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + f" else {otherwise} end"


def _score_sql(terms: list[str], fields: tuple[str, ...]) -> str:
    tier = lambda f, q: f"coalesce(case when {f} = '{q}' then 1000 when lower({f}) = lower('{q}') then 850 when starts_with({f}, '{q}') then 300 when starts_with(lower({f}), lower('{q}')) then 240 when contains({f}, '{q}') then 120 when contains(lower({f}), lower('{q}')) then 90 else 0 end, 0)"
    return " + ".join("greatest(" + ", ".join(tier(f, q) for f in fields) + ")" for q in terms)


FIELDS = ("id", "name", "qualified_name", "file_path", "split_part(file_path, '/', -1)")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"with {SQL_EDGES} select source, target, kind from edges where kind = 'contains' and source like 'scene:%'")
def scan_filter_edges_by_kind(spark, d):
    return edges(spark, d).where("kind = 'contains' and startswith(source, 'scene:')").select("source", "target", "kind")


@query(f"with {SQL_NODES}, {SQL_EDGES} select kind, count(*)::bigint as n from nodes group by kind union all select 'edge:' || kind, count(*)::bigint from edges group by kind")
def project_overview_counts(spark, d):
    n = nodes(spark, d).groupBy("kind").agg(F.count("*").alias("n"))
    return n.unionAll(edges(spark, d).groupBy(F.concat(F.lit("edge:"), "kind").alias("kind")).agg(F.count("*").alias("n")))


@query(f"with {SQL_NODES} select id, kind, name, file_path from nodes order by id")
def list_nodes_ordered(spark, d):
    return nodes(spark, d).select("id", "kind", "name", "file_path").orderBy("id")


@query(f"with {SQL_NODES} select id, kind, name from nodes where id = 'scene:7'")
def point_get_node(spark, d):
    return nodes(spark, d).where("id = 'scene:7'").select("id", "kind", "name")


@query("select o_custkey as cust, o_orderkey as last_order, o_totalprice as price from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r = 1")
def latest_wins_upsert(spark, d):
    return R.first_wins(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("last_order"), F.col("o_totalprice").alias("price"))


@query("select l_orderkey, l_partkey, l_linenumber as first_line from (select *, row_number() over (partition by l_orderkey, l_partkey order by l_linenumber) as r from lineitem) where r = 1")
def first_wins_edge_dedup(spark, d):
    out = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("first_line"))
    return out


@query("select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_nationkey in (3, 7, 11))")
def cascade_delete_anti(spark, d):
    gone = table(spark, d, "customer").where(F.col("c_nationkey").isin(3, 7, 11)).select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(gone, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


#: Stored: all documents, a fifth with other content, and all pages, which are gone; current: all documents and all items.
_STORED = "stored as (select 'doc:' || doc_id as id, case when doc_id % 5 = 0 then 'old' else sha256(text) end as h from documents union all select 'page:' || page_id, sha256(url) from pages), cur as (select 'doc:' || doc_id as id, sha256(text) as h from documents union all select 'item:' || item_id, sha256(text) from benchmark)"
_DIFF = "diff as (select coalesce(s.id, c.id) as id, case when s.id is null then 'added' when c.id is null then 'deleted' when s.h is distinct from c.h then 'modified' else 'unchanged' end as change from stored s full outer join cur c on s.id = c.id)"


def _versions(spark, d):
    rows = lambda name, prefix, key, text: table(spark, d, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.sha2(text, 256).alias("h"))
    docs = rows("documents", "doc:", "doc_id", "text")
    old = table(spark, d, "documents").where("doc_id % 5 = 0").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"))
    stored = docs.join(old.withColumn("old", F.lit("old")), "id", "left").select("id", F.coalesce("old", "h").alias("h"))
    return stored.unionAll(rows("pages", "page:", "page_id", "url")), docs.unionAll(rows("benchmark", "item:", "item_id", "text"))


@query(f"with {_STORED}, {_DIFF} select * from diff")
def sync_full_outer_diff(spark, d):
    return R.full_outer_diff(*_versions(spark, d), "id", "h")


@query(f"with {_STORED} select id, h from cur")
def incremental_equals_full(spark, d):
    stored, current = _versions(spark, d)
    diff = R.full_outer_diff(stored, current, "id", "h")
    kept = stored.join(diff.where("change in ('modified', 'deleted')"), "id", "left_anti")
    return R.upsert(kept, current.join(diff.where("change in ('added', 'modified')"), "id", "left_semi"), ["id"])


@query(f"with {SQL_NODES} select file_path, count(distinct id)::bigint as node_count from nodes group by file_path")
def file_node_recount(spark, d):
    return nodes(spark, d).groupBy("file_path").agg(F.countDistinct("id").alias("node_count"))


@query("select p_partkey, case when n is null then 'resource_missing_ref' when p_size % 3 = 0 then 'resource_subresource' when p_size % 3 = 1 then 'resource_main' else 'resource_external_ref' end as address_kind, case when n is null then null else 'res://part/' || (p_partkey % 16) end as owner_path from part left join (select l_partkey, count(*) as n from lineitem where l_quantity > 45 group by l_partkey) on p_partkey = l_partkey")
def address_role_case(spark, d):
    known = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), F.lit(1).alias("n")).distinct()
    p = table(spark, d, "part").join(known, "p_partkey", "left")
    role = F.when(F.col("n").isNull(), "resource_missing_ref").when(F.col("p_size") % 3 == 0, "resource_subresource").when(F.col("p_size") % 3 == 1, "resource_main").otherwise("resource_external_ref")
    return p.select("p_partkey", role.alias("address_kind"), F.when(F.col("n").isNotNull(), F.concat(F.lit("res://part/"), (F.col("p_partkey") % 16).cast("string"))).alias("owner_path"))


_U = "u2 as (select p_name, p_size, min(p_partkey) as k from part group by 1, 2 having count(*) = 1), u3 as (select p_name, p_brand, p_size, min(p_partkey) as k from part group by 1, 2, 3 having count(*) = 1)"
_REFS = "refs as (select l_orderkey, l_linenumber, p_name, p_brand, p_size from lineitem join part on l_partkey = p_partkey)"


def _refs(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_size")
    return table(spark, d, "lineitem").join(p, "l_partkey").select("l_orderkey", "l_linenumber", "p_name", "p_brand", "p_size")


@query(f"with {_U}, {_REFS} select l_orderkey, l_linenumber, u2.k as target from refs left join u2 using (p_name, p_size)")
def resolve_unique_or_null(spark, d):
    u = R.unique_or_null(table(spark, d, "part"), ["p_name", "p_size"], "p_partkey", "target")
    return _refs(spark, d).join(u, ["p_name", "p_size"], "left").select("l_orderkey", "l_linenumber", "target")


@query(f"with {_U}, {_REFS} select l_orderkey, l_linenumber, coalesce(u2.k, u3.k) as target, case when u2.k is not null then 0 when u3.k is not null then 1 end as tier from refs left join u2 using (p_name, p_size) left join u3 using (p_name, p_brand, p_size)")
def resolve_tiered_coalesce(spark, d):
    out = G.resolve_names(_refs(spark, d), table(spark, d, "part"), [["p_name", "p_size"], ["p_name", "p_brand", "p_size"]], "p_partkey")
    return out.select("l_orderkey", "l_linenumber", "target", "tier")


@query(f"with {_U}, {_REFS}, r as (select refs.*, coalesce(u2.k, u3.k) as t from refs left join u2 using (p_name, p_size) left join u3 using (p_name, p_brand, p_size)) select p_name, count(*)::bigint as n_refs, count(*) filter (where t is null)::bigint as n_open from r group by p_name")
def ambiguous_refs_report(spark, d):
    out = G.resolve_names(_refs(spark, d), table(spark, d, "part"), [["p_name", "p_size"], ["p_name", "p_brand", "p_size"]], "p_partkey")
    return out.groupBy("p_name").agg(F.count("*").alias("n_refs"), F.count_if(F.col("target").isNull()).alias("n_open"))


@query("select 'method:' || o_orderkey as source, 'scene_node:' || o_custkey as target, 'declares' as via from orders where o_orderstatus = 'F' union all select 'method:' || o_orderkey, 'scene:' || c_nationkey, 'handles' from orders join customer on o_custkey = c_custkey where o_totalprice > 200000")
def resolve_two_branch_edges(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    src = F.concat(F.lit("method:"), F.col("o_orderkey").cast("string")).alias("source")
    a = o.where("o_orderstatus = 'F'").select(src, F.concat(F.lit("scene_node:"), F.col("o_custkey").cast("string")).alias("target"), F.lit("declares").alias("via"))
    return a.unionAll(o.where("o_totalprice > 200000").join(c, "o_custkey").select(src, F.concat(F.lit("scene:"), F.col("c_nationkey").cast("string")), F.lit("handles")))


@query("select distinct 'method:' || l_orderkey as source, 'script:' || p_name as target, 'instantiates_scene' as via from lineitem join part on l_partkey = p_partkey where p_size <= 5")
def promote_resource_edges(spark, d):
    e = table(spark, d, "lineitem").select(F.concat(F.lit("method:"), F.col("l_orderkey").cast("string")).alias("source"), F.concat(F.lit("resource:"), F.col("l_partkey").cast("string")).alias("target"))
    scripts = table(spark, d, "part").where("p_size <= 5").select(F.col("p_partkey").cast("string").alias("path"), F.concat(F.lit("script:"), "p_name").alias("script"))
    return e.withColumn("path", F.substring("target", 10, 100)).join(scripts, "path").select("source", F.col("script").alias("target"), F.lit("instantiates_scene").alias("via")).distinct()


@query("select conv_id, turn, role, max(case when role = 'user' then turn end) over (partition by conv_id order by turn rows unbounded preceding) as scope_turn from conversations")
def asof_containing_scope(spark, d):
    c = table(spark, d, "conversations")
    return R.asof_last(c, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")), "scope_turn").select("conv_id", "turn", "role", "scope_turn")


@query("select c_custkey, r_name || '.' || n_name || '.' || c_name as receiver from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def receiver_path_fold(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat_ws(".", "r_name", "n_name", "c_name").alias("receiver"))


_VISIBLE = "visible as (select e.* from edges e left join nodes n on e.target = n.id where e.provenance = 'resolver' or not exists (select 1 from edges x join nodes m on x.target = m.id where x.provenance = 'resolver' and x.source = e.source and x.kind = e.kind and m.file_path = n.file_path))"


@query("with raw as (select l_orderkey as s, l_partkey % 16 as f, 'attaches' as kind, case when l_linenumber = 1 then 'resolver' else 'parser' end as p, l_linenumber as line from lineitem) select s, f, line, p from raw where p = 'resolver' or not exists (select 1 from raw x where x.p = 'resolver' and x.s = raw.s and x.f = raw.f)")
def superseded_edge_antijoin(spark, d):
    raw = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("s"), (F.col("l_partkey") % 16).alias("f"), F.col("l_linenumber").alias("line"), F.when(F.col("l_linenumber") == 1, "resolver").otherwise("parser").alias("p"))
    best = raw.where("p = 'resolver'").select("s", "f").distinct()
    return raw.where("p = 'parser'").join(best, ["s", "f"], "left_anti").unionByName(raw.where("p = 'resolver'")).select("s", "f", "line", "p")


@query(f"with {_U}, {_REFS} select l_orderkey, l_linenumber, p_name from refs where not exists (select 1 from u2 where u2.p_name = refs.p_name and u2.p_size = refs.p_size) and not exists (select 1 from u3 where u3.p_name = refs.p_name and u3.p_brand = refs.p_brand and u3.p_size = refs.p_size)")
def resolved_ref_antijoin(spark, d):
    p = table(spark, d, "part")
    a, b = R.unique_or_null(p, ["p_name", "p_size"], "p_partkey", "t"), R.unique_or_null(p, ["p_name", "p_brand", "p_size"], "p_partkey", "t")
    return _refs(spark, d).join(a, ["p_name", "p_size"], "left_anti").join(b, ["p_name", "p_brand", "p_size"], "left_anti").select("l_orderkey", "l_linenumber", "p_name")


TERMS = ["small ring", "small", "ring"]
_SEARCH = f"scored as (select id, kind, name, file_path, qualified_name, {_score_sql(TERMS, FIELDS)} as hit, {_case_sql('kind', T.KIND_PRIORITY, 0)} as prior from nodes)"


@query(f"with {SQL_NODES}, {_SEARCH} select id, kind, name, (hit + prior)::int as score from scored where hit > 0")
def search_tiered_score(spark, d):
    return G.search(nodes(spark, d), TERMS, None).select("id", "kind", "name", "score")


@query(f"with {SQL_NODES}, {_SEARCH} select id, (hit + prior)::int as score from scored where hit > 0 order by hit + prior desc, qualified_name, id limit 20")
def search_ranked_top20(spark, d):
    return G.search(nodes(spark, d), TERMS, 20).select("id", "score")


@query("select doc_id from documents where regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])the[^\\p{L}\\p{N}]+of($|[^\\p{L}\\p{N}])')")
def search_fts_phrase(spark, d):
    return table(spark, d, "documents").where(F.rlike(F.lower("text"), F.lit(r"(^|[^\p{L}\p{N}])the[^\p{L}\p{N}]+of($|[^\p{L}\p{N}])"))).select("doc_id")


@query("select p_partkey, p_name from part where contains(lower(p_name), 'ring') or contains(lower(p_brand), '#1')")
def search_literal_like(spark, d):
    return table(spark, d, "part").where("instr(lower(p_name), 'ring') > 0 or instr(lower(p_brand), '#1') > 0").select("p_partkey", "p_name")


@query("with t as (select unnest(['ring', 'small', 'green']) as term), s as (select term, p_partkey, case when starts_with(lower(p_name), term) then 240 else 90 end as score from part, t where contains(lower(p_name), term)) select term, p_partkey, score, place::int as place from (select *, row_number() over (partition by term order by score desc, p_partkey) as place from s) where place <= 12")
def search_topk_per_term(spark, d):
    terms = F.array(*(F.lit(x) for x in ("ring", "small", "green")))
    p = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("low"))
    s = p.select("p_partkey", "low", F.explode(F.filter(terms, lambda t: F.instr(F.col("low"), t) > 0)).alias("term"))
    s = s.select("term", "p_partkey", F.when(F.startswith("low", F.col("term")), 240).otherwise(90).alias("score"))
    return R.topk_per_group(s, ["term"], [F.desc("score"), "p_partkey"], 12, "place")


_STRATEGY = "case " + " ".join("when regexp_matches(q, '" + pattern.replace("'", "''") + f"') then '{name}'" for name, pattern in T.STRATEGIES) + " else 'general' end"
_QUERIES = "q as (select 'part:' || p_partkey as k, p_name as q from part union all select 'page:' || page_id, url from pages union all select 'event:' || event_id, event_type || case when event_id % 3 = 0 then ' callers' when event_id % 3 = 1 then ' source window' else '' end from events union all select 'item:' || item_id, text from benchmark)"


def _texts(spark, d):
    tail = F.when(F.col("event_id") % 3 == 0, " callers").when(F.col("event_id") % 3 == 1, " source window").otherwise("")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("k")
    parts = [table(spark, d, "part").select(key("part:", "p_partkey"), F.col("p_name").alias("q")), table(spark, d, "pages").select(key("page:", "page_id"), "url"), table(spark, d, "events").select(key("event:", "event_id"), F.concat("event_type", tail)), table(spark, d, "benchmark").select(key("item:", "item_id"), "text")]
    return reduce(DataFrame.unionAll, parts)


@query(f"with {_QUERIES} select k, {_STRATEGY} as strategy from q")
def plan_strategy_classify(spark, d):
    return _texts(spark, d).select("k", T.strategy(F.col("q")).alias("strategy"))


_STEM = "case when length(w) > 4 and ends_with(w, 'ies') then w[:length(w) - 3] || 'y' when length(w) > 4 and ends_with(w, 's') then w[:length(w) - 1] else w end"


@query(f"with w as (select item_id, unnest(string_split(regexp_replace(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g'), ' ')) as w from benchmark) select distinct item_id, {_STEM} as term from w where length(w) >= 3")
def plan_terms_stemming(spark, d):
    ascii_text = F.regexp_replace(F.lower(F.regexp_replace("text", "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+", " ")
    return table(spark, d, "benchmark").select("item_id", F.explode(T.text_terms(ascii_text)).alias("term"))


@query("select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/[^/]*$', '') as directory, regexp_extract(url, '([^/]*)$', 1) as leaf from pages")
def plan_anchors(spark, d):
    bare = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, d, "pages").select("page_id", F.regexp_replace(bare, "/[^/]*$", "").alias("directory"), F.regexp_extract("url", "([^/]*)$", 1).alias("leaf"))


@query("with p as (select 0 as pool, 'part:' || p_partkey as id, p_partkey as o from part where lower(p_name) = 'small ring' union all select 1, 'part:' || p_partkey, p_partkey from part where contains(lower(p_name), 'ring') union all select 2, 'supplier:' || s_suppkey, s_suppkey from supplier where s_acctbal > 9000), r as (select *, row_number() over (partition by id order by pool, o) as n from p) select pool, id from r where n = 1 order by pool, o, id limit 40")
def pools_prioritized_union(spark, d):
    p, s = table(spark, d, "part"), table(spark, d, "supplier")
    pool = lambda df, n, prefix, key: df.select(F.lit(n).alias("pool"), F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.col(key).alias("o"))
    rows = pool(p.where("lower(p_name) = 'small ring'"), 0, "part:", "p_partkey").unionAll(pool(p.where("instr(lower(p_name), 'ring') > 0"), 1, "part:", "p_partkey")).unionAll(pool(s.where("s_acctbal > 9000"), 2, "supplier:", "s_suppkey"))
    return R.first_wins(rows, ["id"], ["pool", "o"]).orderBy("pool", "o", "id").limit(40).select("pool", "id")


@query(f"with {SQL_EDGES}, e as (select source as id from edges union all select target from edges where target <> source) select id, count(*)::bigint as degree from e group by id")
def rank_by_degree(spark, d):
    return G.degrees(edges(spark, d))


@query(f"with {SQL_NODES} select id, file_path from (select *, row_number() over (partition by file_path order by start_line, id) as r from nodes) where r <= 2")
def rank_limit_per_file(spark, d):
    return R.topk_per_group(nodes(spark, d), ["file_path"], ["start_line", "id"], 2).select("id", "file_path")


@query("select doc_id, case when source in ('src0', 'src1') then 30 when source in ('src2', 'src3') then 20 else 0 end as priority from documents")
def rank_symbol_priority_case(spark, d):
    s = F.col("source")
    return table(spark, d, "documents").select("doc_id", F.when(s.isin("src0", "src1"), 30).when(s.isin("src2", "src3"), 20).otherwise(0).alias("priority"))


_SEEDS = f"seeds as (select id as seed from scored where hit > 0 order by hit + prior desc, qualified_name, id limit 12)"
_HOP = f"hop as (select seed, 'in' as direction, kind, source as neighbour from edges join seeds on target = seed union all select seed, 'out', kind, target from edges join seeds on source = seed)"


@query(f"with {SQL_NODES}, {SQL_EDGES}, {_SEARCH}, {_SEEDS}, {_HOP} select seed, direction, kind, neighbour, {_case_sql('kind', T.RELATION_PRIORITY, 50)} as priority from hop")
def expand_one_hop(spark, d):
    return G.expand(G.search(nodes(spark, d), TERMS, 12), edges(spark, d))


@query(f"with {SQL_NODES}, {SQL_EDGES}, {_SEARCH}, {_SEEDS}, {_HOP} select seed, direction, kind, neighbour from hop order by {_case_sql('kind', T.RELATION_PRIORITY, 50)}, seed, neighbour, direction limit 80")
def relationship_priority_sort(spark, d):
    return G.expand(G.search(nodes(spark, d), TERMS, 12), edges(spark, d)).orderBy("priority", "seed", "neighbour", "direction").limit(80).drop("priority")


@query(f"with {SQL_EDGES}, s as (select 'scene:' || n_nationkey as id from nation union all select 'project:' || r_regionkey from region) select source, target, kind from edges where source in (select id from s) and target in (select id from s) order by source, target limit 12")
def paths_between_seeds(spark, d):
    n = nodes(spark, d).where("kind in ('project', 'scene')").select("id")
    e = edges(spark, d).join(n.withColumnRenamed("id", "source"), "source", "left_semi").join(n.withColumnRenamed("id", "target"), "target", "left_semi")
    return e.orderBy("source", "target").limit(12).select("source", "target", "kind")


@query(f"with {SQL_NODES}, {SQL_EDGES}, {_SEARCH}, {_SEEDS}, {_HOP} select n.file_path, count(*)::bigint as relationships from hop join nodes n on neighbour = n.id group by n.file_path")
def blast_radius_files(spark, d):
    hop = G.expand(G.search(nodes(spark, d), TERMS, 12), edges(spark, d))
    return hop.join(nodes(spark, d).select(F.col("id").alias("neighbour"), "file_path"), "neighbour").groupBy("file_path").agg(F.count("*").alias("relationships"))


@query(
    f"""with {SQL_NODES}, {SQL_EDGES}, t as (select id as seed from nodes where kind = 'scene'),
h as (select seed, 'in' as direction, kind, source as neighbour from edges join t on target = seed union all select seed, 'out', kind, target from edges join t on source = seed),
g as (select h.*, case when h.kind = 'calls' then case when direction = 'in' then 'callers' else 'callees' end else case when direction = 'in' then 'dependents' else 'dependencies' end end as "group",
 case when h.kind = 'references_symbol' and a.file_path <> b.file_path then 0 when h.kind = 'references_symbol' then 10 when h.kind = 'calls' and a.file_path <> b.file_path then 20 when h.kind = 'calls' then 30 when h.kind = 'contains' then 60 when a.file_path <> b.file_path then 40 else 50 end as priority
 from h join nodes a on h.seed = a.id join nodes b on h.neighbour = b.id),
o as (select * from (select *, row_number() over (partition by seed, "group", neighbour order by priority, kind) as r from g) where r = 1),
p as (select *, row_number() over (partition by seed, "group" order by priority, neighbour) as place, greatest(count(*) over (partition by seed, "group") - 8, 0) as omitted from o)
select seed, "group", place::int as place, neighbour, kind, priority, omitted::bigint as omitted from p where place <= 8"""
)
def notes_topk_four_groups(spark, d):
    n = nodes(spark, d)
    return G.notes(edges(spark, d), n.where("kind = 'scene'"), n)


@query("select conv_id, turn as start_line, coalesce(lead(turn) over (partition by conv_id order by turn) - 1, turn + 24) as end_line from conversations")
def inferred_end_line_lead(spark, d):
    after = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").select("conv_id", F.col("turn").alias("start_line"), F.coalesce(after - 1, F.col("turn") + 24).alias("end_line"))


@query("select doc_id, array_to_string(string_split(regexp_replace(text, '\\r\\n', chr(10), 'g'), chr(10))[2:5], chr(10)) as source_window from documents")
def source_window(spark, d):
    lines = F.split("text", "\r?\n")
    return table(spark, d, "documents").select("doc_id", F.array_join(F.slice(lines, 2, 4), "\n").alias("source_window"))


@query("with r as (select source, doc_id, n_chars, sum(n_chars) over (partition by source order by doc_id rows unbounded preceding) as used from documents) select source, doc_id, used::bigint as used from r where used <= 48000")
def budget_running_sum(spark, d):
    w = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "documents").select("source", "doc_id", F.sum("n_chars").over(w).alias("used")).where("used <= 48000")


@query(f"with {SQL_NODES} select case when kind = 'property' then 'resource' when kind in ('scene', 'scene_node') then 'scene' when kind = 'method' then 'script' else 'other' end as category, count(*)::bigint as omitted from (select *, row_number() over (partition by file_path order by start_line, id) as r from nodes) where r > 2 group by 1")
def omitted_category_counts(spark, d):
    k = F.col("kind")
    category = F.when(k == "property", "resource").when(k.isin("scene", "scene_node"), "scene").when(k == "method", "script").otherwise("other")
    left_out = nodes(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("file_path").orderBy("start_line", "id"))).where("r > 2")
    return left_out.groupBy(category.alias("category")).agg(F.count("*").alias("omitted"))


@query("with p as (select regexp_replace(url, '/[^/]*$', '') as path, min(page_id) as f from pages group by 1) select path, 'p' || row_number() over (order by f, path) as ref from p")
def path_intern_ordinals(spark, d):
    p = table(spark, d, "pages").select(F.regexp_replace("url", "/[^/]*$", "").alias("path"), "page_id")
    return R.intern(p, "path", "page_id", "p")


@query(f"with {SQL_EDGES}, e as (select source, target from edges where kind = 'contains' and source like 'project:%'), u as (select source as id, 0 as o from e union all select target, 1 from e), f as (select id, min(o) as o from u group by id) select id, 'n' || row_number() over (order by o, id) as ref from f")
def node_intern_ordinals(spark, d):
    e = edges(spark, d).where("kind = 'contains' and startswith(source, 'project:')")
    u = e.select(F.col("source").alias("id"), F.lit(0).alias("o")).unionAll(e.select("target", F.lit(1)))
    return R.intern(u, "id", "o", "n")


@query(f"with {SQL_NODES}, {SQL_EDGES} select kind, count(*)::bigint as n, count(*) filter (where not exists (select 1 from nodes where id = target))::bigint as orphans from edges group by kind")
def orphan_invariant_check(spark, d):
    known = nodes(spark, d).select(F.col("id").alias("target"), F.lit(1).alias("known")).distinct()
    return edges(spark, d).join(known, "target", "left").groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("known").isNull()).alias("orphans"))


@query("select page_id, regexp_extract(html, 'href=\"([^\"]*)\"', 1) as href, regexp_extract(html, 'lang=\"([^\"]*)\"', 1) as lang, len(regexp_extract_all(html, '[a-z]+=\"[^\"]*\"'))::int as n_attributes from pages")
def parse_attributes(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", 'href="([^"]*)"', 1).alias("href"), F.regexp_extract("html", 'lang="([^"]*)"', 1).alias("lang"), F.regexp_count("html", F.lit('[a-z]+="[^"]*"')).alias("n_attributes"))


@query("with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents), s as (select *, sum(case when regexp_matches(line, '^[A-Z]') and length(line) < 60 then 1 else 0 end) over (partition by doc_id order by n rows unbounded preceding) as section from l) select doc_id, section::bigint as section, min(n)::bigint as first_line, count(*)::bigint as n_lines from s group by 1, 2")
def parse_sections_islands(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    head = F.rlike("line", F.lit("^[A-Z]")) & (F.char_length("line") < 60)
    s = lines.withColumn("section", F.sum(head.cast("long")).over(Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("doc_id", "section").agg((F.min("n") + 1).cast("long").alias("first_line"), F.count("*").alias("n_lines"))


@query("select page_id, unnest(regexp_extract_all(html, '([A-Za-z_]\\w*)\\s*\\(', 1)) as callee from pages")
def parse_call_sites(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1))).alias("callee"))


@query("select page_id, length(regexp_replace(html, '\"[^\"]*\"', '\"\"', 'g'))::int as masked_chars from pages")
def string_mask_strip(spark, d):
    return table(spark, d, "pages").select("page_id", F.char_length(F.regexp_replace("html", '"[^"]*"', '""')).alias("masked_chars"))


@query("select p_partkey, p_name || case when count(*) over (partition by p_name, p_brand) > 1 then '@' || p_partkey else '' end as symbol from part")
def duplicate_symbol_suffix(spark, d):
    many = F.count("*").over(Window.partitionBy("p_name", "p_brand")) > 1
    return table(spark, d, "part").select("p_partkey", F.concat("p_name", F.when(many, F.concat(F.lit("@"), F.col("p_partkey").cast("string"))).otherwise("")).alias("symbol"))


@query("select user_id, event_type, event_id, ts from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1")
def pending_state_latest(spark, d):
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    return e.select("user_id", "event_type", "last.event_id", "last.ts")


@query("with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as n from g) select user_id, min(ts) as first_ts, count(*)::bigint as changes from s group by user_id, n")
def debounce_sessions(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("changes"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("first_ts"), "changes")


@query(f"with {_STORED}, {_DIFF}, pending as (select 'doc:' || event_id as id from events) select id, max(change) as change, bool_or(watched) as watched from (select id, change, false as watched from diff where change <> 'unchanged' union all select id, null, true from pending) group by id")
def freshness_merge(spark, d):
    diff = R.full_outer_diff(*_versions(spark, d), "id", "h").where("change <> 'unchanged'").withColumn("watched", F.lit(False))
    pending = table(spark, d, "events").select(F.concat(F.lit("doc:"), F.col("event_id").cast("string")).alias("id"), F.lit(None).cast("string").alias("change"), F.lit(True).alias("watched"))
    return diff.unionByName(pending).groupBy("id").agg(F.max("change").alias("change"), F.bool_or("watched").alias("watched"))


def flagship(spark, d):
    """Search, twelve seeds, one hop, ordered relationships."""
    return expand_one_hop(spark, d)
