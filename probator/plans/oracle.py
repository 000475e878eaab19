"""SQL for DuckDB that says, independently of the Spark code, what each query of ``catalog.py`` gives."""

from __future__ import annotations

ORDERS = """o as (select *, case when o_totalprice > 150000 then 1 else 0 end as label, case when o_orderkey % 10 < 7 then 'Train' when o_orderkey % 10 < 9 then 'holdout' else 'other' end as split, case when o_orderkey % 10 < 6 then 'train' else 'TEST' end as fold,
    case when o_custkey % 50 <> 0 then o_custkey end as unit, case when o_orderkey % 9 <> 0 then o_orderdate end as seen_at from orders)"""
LINES = "ln as (select *, concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(l_quantity as int), cast(round(l_extendedprice * 100) as bigint)) as row_id from lineitem)"
#: NaN is missing, so it is null here.
MESSY = """m as (select o_orderkey as key, case when o_orderkey % 7 <> 0 then o_custkey end as cust, case when o_orderkey % 11 = 0 then 'infinity'::double when o_orderkey % 13 = 0 then null when o_orderkey % 17 <> 0 then o_totalprice end as price, 1 as same,
    case when o_orderkey % 200 = 0 then 'b' else 'a' end as mostly, o_orderstatus as ab, null::double as nothing, case when o_orderkey % 100 = 0 then 'x' end as sparse, 'c' || o_custkey as name from orders)"""
#: (name in the result, column above, numeric)
COLUMNS = (("cust", "cust", True), ("price", "price", True), ("same", "same", True), ("mostly", "mostly", False), ("a b", "ab", False), ("nothing", "nothing", True), ("sparse", "sparse", False), ("name", "name", False))


def drawn(seed: int, key: str, keys: str) -> str:
    """(k, place, n): the keys of a query in the order of the MD5 of seed and key."""
    return f"select {key} as k, row_number() over (order by md5(concat('{seed}|', coalesce(cast({key} as varchar), ''))), {key} nulls first) as place, count(*) over () as n from ({keys})"


RANDOM = f"part as (select k as row_id, case when place <= ceil(0.25 * n) then 'test' else 'train' end as part from ({drawn(11, 'o_orderkey', 'select o_orderkey from orders')}))"
RANDOM_LINES = f"part as (select k as row_id, case when place <= ceil(0.25 * n) then 'test' else 'train' end as part from ({drawn(11, 'row_id', 'select row_id from ln')}))"


def profile_sql() -> str:
    out = []
    for i, (name, c, number) in enumerate(COLUMNS):
        f = f"case when not isinf({c}::double) then {c}::double end" if number else "null::double"
        text = f"case when isinf({c}::double) then 'Infinity' else cast({c} as varchar) end" if number else c
        out.append(f"""select {i} as position, '{name}' as column_name, count(*) as n_rows, count({c}) as n_present, count(*) - count({c}) as n_missing, (count(*) - count({c})) / count(*) as missing_fraction, count(distinct {c}) as n_unique,
            count(distinct {c}) + max(case when {c} is null then 1 else 0 end) <= 1 as is_constant, coalesce((select max(n) from (select count(*) as n from m where {c} is not null group by {c})) >= 0.98 * count(*), false) as is_near_constant,
            count(distinct {c}) + max(case when {c} is null then 1 else 0 end) > 1 and (select max(n) from (select count(*) as n from m group by {c})) >= 0.98 * count(*) as modal_near, {f'count(case when isinf({c}::double) then 1 end)' if number else '0::bigint'} as n_infinite,
            min({f}) as minimum, quantile_cont({f}, 0.05) as q05, quantile_cont({f}, 0.5) as median, quantile_cont({f}, 0.95) as q95, max({f}) as maximum, avg({f}) as mean, stddev_samp({f}) as sd,
            (select {text} from m where {c} is not null group by {c} order by count(*) desc, {text} limit 1) as top_value, coalesce((select count(*) from m where {c} is not null group by {c} order by 1 desc limit 1), 0) as top_count, {number} as is_numeric from m""")
    return f"{MESSY}, prof as ({' union all '.join(out)})"


def sizes_sql(source: str, key: str) -> str:
    return f"select count(*) as n_groups, coalesce(sum(case when c > 1 then c end), 0)::bigint as repeated_rows, min(c) as least, quantile_cont(c, 0.5) as median, max(c) as most from (select count(*) as c from {source} group by {key})"


def entity_sql(name: str, c: str) -> str:
    return f"""select '{name}' as entity, count(*) as n_ids, (select count(*) from m where {c} is null) as n_missing, min(c) as least, quantile_cont(c, 0.5) as median, max(c) as most, coalesce(sum(case when c > 1 then c end), 0)::bigint as repeated_rows,
        case when count(*) = 0 then 'NOT_ASSESSABLE' else 'ASSESSED' end as status from (select count(*) as c from m where {c} is not null group by {c})"""


def conflicts_sql(source: str, key: str, value: str) -> str:
    return f"select count(*) as n_ids, count(case when v > 1 then 1 end) as n_conflicts, coalesce(sum(case when v > 1 then n end), 0)::bigint as affected_rows from (select count(distinct {value}) as v, count(*) as n from {source} where {key} is not null group by {key})"


def groups_sql(source: str, row: str, key: str, seed: int) -> str:
    return f"select {row} as row_id, case when place <= ceil(0.25 * n) then 'test' else 'train' end as part from {source} join ({drawn(seed, 'g', f'select distinct {key} as g from {source}')}) on {key} is not distinct from k"


def shared_sql(parted: str, keys: str, complete: bool = True) -> str:
    """(n_train, n_test, shared, test_fraction) of the keys of a table with a column part."""
    parts = [k.strip() for k in keys.split(",")]
    known = " and ".join(f"{k} is not null" for k in parts) if complete else "true"
    return f"""select count(case when a then 1 end) as n_train, count(case when b then 1 end) as n_test, count(case when a and b then 1 end) as shared, round(count(case when a and b then 1 end) / greatest(count(case when b then 1 end), 1), 6) as test_fraction
        from (select bool_or(part = 'train') as a, bool_or(part = 'test') as b from {parted} where part <> 'excluded' and {known} group by {keys})"""


def overlap_sql(parted: str) -> str:
    """What the audit of orders looks at: both entities, their pair, and records by price and status."""
    return " union all ".join(f"select '{kind}' as kind, '{subject}' as subject, * from ({shared_sql(parted, keys, kind != 'record')})" for kind, subject, keys in (("entity", "customer", "o_custkey"), ("entity", "priority", "o_orderpriority"), ("pair", "o_custkey,o_orderpriority", "o_custkey, o_orderpriority"), ("record", "", "o_totalprice, o_orderstatus")))


def values_sql(columns: str, rows: list[tuple]) -> str:
    """Expected rows, written out."""
    cell = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) as v({columns})"


def midrank(x: str, over: str = "") -> str:
    """The average rank of x."""
    by = f"partition by {over} " if over else ""
    tie = f"partition by {over}, {x}" if over else f"partition by {x}"
    return f"(rank() over ({by}order by {x}) + (count(*) over ({tie}) - 1) / 2)"


def correlation(a: str, b: str) -> str:
    return f"(case when max({a}) - min({a}) > 1e-12 and max({b}) - min({b}) > 1e-12 then covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b})) end)"


MEANS = f"""{LINES}, {RANDOM_LINES}, tr as (select ln.* from ln join part on part.row_id = ln.row_id where part = 'train'), te as (select ln.* from ln join part on part.row_id = ln.row_id where part = 'test'),
    g as (select sum(l_extendedprice::decimal(18,4))::double / count(*) as gm from tr), lm as (select l_partkey as k, sum(l_extendedprice::decimal(18,4))::double / count(*) as m from tr group by 1), rm as (select l_suppkey as k, sum(l_extendedprice::decimal(18,4))::double / count(*) as m from tr group by 1),
    pred as (select te.row_id, l_extendedprice as y_true, gm as global_mean, lm.m as left_mean, rm.m as right_mean, lm.m + rm.m - gm as additive from te, g left join lm on lm.k = l_partkey left join rm on rm.k = l_suppkey)"""
RANKINGS = "r as (select o_orderkey % 3 as run, o_orderpriority as grp, o_custkey % 40 as candidate, max(o_totalprice) as score from orders group by all)"
RECORDS = """rec as (select case when o_orderpriority like '1%' then 'rows' else 'customers' end as scenario, case when o_orderpriority like '1%' then 'random' else 'group' end as strategy, case when o_orderstatus = 'F' then 'x' else 'y' end as representation, o_orderkey % 4 as seed,
    case when o_custkey % 4 = 0 then 'dummy' else 'm' || (o_custkey % 3) end as model, o_orderkey % 7 < 2 as permuted, o_orderkey % 5 as draw, 'p' || (o_orderkey % 2) as fp, case when o_orderkey % 7 < 2 then o_totalprice / 400000 * 0.4 when o_orderkey % 11 <> 0 then o_totalprice / 400000 end as v from orders),
    held as (select * from rec where not permuted and model <> 'dummy')"""


def top_sql(k: int, order: str = "desc") -> str:
    return f"t as (select run, grp, candidate from (select *, row_number() over (partition by run, grp order by score {order}, candidate) as place from r) where place <= {k})"


def ranking_sql(source: str, k: int, name: str) -> str:
    return f"""select {name} as representation, {k} as k, round(a, 6) as mean_jaccard, b as comparisons, round(c, 6) as unstable_fraction, case when b > 0 then 'ASSESSED' else 'NOT_ASSESSABLE' end as status from (
        with t as (select run, grp, candidate from (select *, row_number() over (partition by run, grp order by score desc, candidate) as place from ({source})) where place <= {k}),
        s as (select run, grp, list(candidate) as l from t group by all), p as (select len(list_intersect(x.l, y.l)) / len(list_distinct(list_concat(x.l, y.l))) as j from s x join s y on x.grp = y.grp and x.run < y.run),
        chosen as (select grp, candidate, count(*) as c from t group by all), n as (select grp, count(distinct run) as runs from t group by grp)
        select (select avg(j) from p) as a, (select count(*) from p) as b, (select avg(case when chosen.c < runs then 1.0 else 0.0 end) from chosen join n using (grp)) as c)"""


def partition_sql(source: str) -> str:
    return f"""select case when count(*) > 0 and count(*) = count(fp) then count(distinct fp) end as distinct_partitions, case when count(*) > 0 and count(*) = count(fp) then (select round(quantile_cont(sd, 0.5), 6) from (select stddev_samp(m) as sd from
        (select scenario, representation, model, quantile_cont(v, 0.5) as m from {source} group by scenario, representation, model, fp) group by scenario, representation, model)) end as median_sd from {source}"""


#: The scenario facts of VERDICT_CASE, for each representation.
FACTS = f"""with {RECORDS}, names as (select * from (values (0, 'rows'), (1, 'customers')) as n(position, scenario)), wanted as (select * from names, (select distinct representation from rec)),
    ctl as (select * from rec where permuted and model <> 'dummy'), per as (select scenario, representation, model, quantile_cont(v, 0.5) as median, stddev_samp(v) as sd from held semi join ctl using (scenario, representation, model) group by all having count(v) > 0),
    best as (select * from (select *, row_number() over (partition by scenario, representation order by median desc, model) as place from per) where place = 1),
    draws as (select scenario, representation, draw, quantile_cont(v, 0.5) as v from ctl semi join best using (scenario, representation, model) group by all),
    nul as (select scenario, representation, count(*) as draws, quantile_cont(d.v, 0.5) as null_median, quantile_cont(d.v, 0.05) as null_q05, quantile_cont(d.v, 0.95) as null_q95, (1 + count(case when d.v >= median then 1 end)) / (1 + count(*)) as p_value from draws d join best using (scenario, representation) group by all),
    chance as (select representation, quantile_cont(v, 0.5) as random_median from held where strategy = 'random' group by 1)
    select position::int as position, w.scenario, w.representation, model, round(median, 6) as median, round(sd, 6) as sd, round(random_median, 6) as random_median, coalesce(draws, 0) as draws, round(null_median, 6) as null_median, round(null_q05, 6) as null_q05, round(null_q95, 6) as null_q95, round(p_value, 6) as p_value
    from wanted w left join best using (scenario, representation) left join nul using (scenario, representation) left join chance using (representation)"""

ORACLE_SQL = {
    # --- sources and columns
    "s01_s02_s03_read_table": "select nation.*, suffix from nation, (values ('csv'), ('tsv'), ('pq')) as s(suffix)",
    "s14_s15_s20_prediction_sink": "select 'run' || (o_orderkey % 4) as run_id, count(*) as n, min(o_orderkey) as first from orders where o_orderkey % 4 in (1, 3) group by 1",
    "s18_o03_preview": f"with {profile_sql()} select column_name, case column_name when 'price' then 'target' else '' end as roles, case column_name when 'cust' then 'bigint' when 'same' then 'int' when 'price' then 'double' when 'nothing' then 'double' else 'string' end as physical_type, n_missing, round(missing_fraction, 6) as missing_fraction, n_unique, round(median, 6) as median, top_count from prof where position < 4",
    "s19_figures": """with e as (select min(o_totalprice) as lo, (max(o_totalprice) - min(o_totalprice)) / 20 as w from orders), b as (select unnest(range(20))::int as bin),
        c as (select least(floor((o_totalprice - lo) / w), 19)::int as bin, count(*) as n from orders, e group by 1) select bin, round(lo + bin * w, 4) as low, round(lo + (bin + 1) * w, 4) as high, coalesce(n, 0) as n from b cross join e left join c using (bin)""",
    "s19_entity_figure": f"with {ORDERS} select rows, count(*) as n_ids from (select count(*) as rows from o where unit is not null group by unit) group by rows",
    "f20_f18_json_safe": f"""with {MESSY} select key, round(case when not isinf(price) then price end, 4) as price, '{{"key":' || key || ',"same":1}}' as nested from m""",
    "a01_missing_counts": f"with {profile_sql()} select column_name, n_missing from prof where n_missing > 0",
    "a02_a03_constant_columns": f"with {profile_sql()} select column_name, case when is_constant then 'constant' else 'near_constant' end as kind from prof where is_constant or modal_near",
    "a05_invalid_values": f"with {profile_sql()} select column_name, n_infinite from prof where n_infinite > 0",
    "a06_high_cardinality": f"with {profile_sql()} select column_name, n_unique, n_unique > least(100, greatest(20, n_rows // 2)) as is_high from prof where not is_numeric",
    "a16_a04_column_profile": f"""with {profile_sql()} select position, column_name, n_rows, n_present, n_missing, round(missing_fraction, 6) as missing_fraction, n_unique, is_constant, is_near_constant, modal_near, n_infinite, round(minimum, 4) as minimum, round(q05, 4) as q05, round(median, 4) as median,
        round(q95, 4) as q95, round(maximum, 4) as maximum, round(mean, 4) as mean, round(sd, 3) as sd, top_value, top_count, is_numeric from prof""",
    "o02_most_missing": f"with {profile_sql()} select column_name, n_missing, round(missing_fraction, 6) as missing_fraction from prof where n_missing > 0 order by missing_fraction desc, position limit 3",
    "p01_p12_roles": values_sql("column_name, roles, modelled, modelled_by_default", [
        ("o_orderkey", "feature", True, True), ("o_custkey", "entity:customer, bootstrap_unit", False, False), ("o_orderstatus", "feature, representation:customer", True, True), ("o_totalprice", "target", False, False), ("o_orderdate", "context/unassigned", False, True),
        ("o_orderpriority", "entity:priority", False, False), ("label", "feature", True, True), ("split", "post_outcome, split:given", False, False), ("fold", "metadata:batch_id", False, False), ("unit", "context/unassigned", False, True), ("seen_at", "metadata:time_column", False, False),
    ]),
    "s22_m19_m20_declarations": values_sql("fact, value", [
        ("unconfirmed", "batch"), ("unconfirmed", "entities"), ("unconfirmed", "features"), ("ranking_group", "o_orderpriority"), ("ranking_candidate", "o_custkey"), ("curve_group:rows", None), ("curve_group:customers", "o_custkey"), ("curve_group:later", None), ("curve_group:given", None),
        *(("declared", c) for c in ("fold", "label", "o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice", "seen_at", "split")),
    ]),
    "a29_missing_metadata": "select 'replicate identifiers' as missing",
    # --- audits
    "a07_duplicate_rows": "select (select count(*) from orders) as n_rows, (select count(*) from orders) - count(*) as n_duplicates from (select distinct o_custkey, o_orderstatus, o_orderpriority from orders)",
    "a08_a09_entity_summary": f"with {MESSY} {entity_sql('cust', 'cust')} union all {entity_sql('a b', 'ab')} union all {entity_sql('nothing', 'nothing')}",
    "a10_label_conflicts": f"with {ORDERS} {conflicts_sql('o', 'unit', 'o_orderstatus')}",
    "a11_representation_conflicts": conflicts_sql("lineitem", "l_partkey", "l_suppkey"),
    "a12_pair_structure": """with p as (select l_partkey as l, l_suppkey as r, count(*) as n, count(distinct l_quantity) as v from lineitem group by all), a as (select count(*) as d from p group by l), b as (select count(*) as d from p group by r)
        select (select count(*) from p) as n_pairs, (select coalesce(sum(n), 0)::bigint from p where n > 1) as repeated_rows, (select count(*) from p where v > 1) as conflicting_pairs, round((select count(*) from p) / ((select count(*) from a) * (select count(*) from b)), 9) as density,
        (select min(d) from a) as left_min, (select quantile_cont(d, 0.5) from a) as left_median, (select max(d) from a) as left_max, (select min(d) from b) as right_min, (select quantile_cont(d, 0.5) from b) as right_median, (select max(d) from b) as right_max""",
    "a13_o01_class_counts": "select o_orderstatus as class, count(*) as n from orders group by 1",
    "a14_d11_binary_encoding": f"""with {ORDERS}, c as (select label, case when o_orderkey % 5 <> 0 then label + 1 end as coded, o_orderstatus from o)
        select 'label' as target, count(*) - count(label) as n_missing, count(distinct label) as n_classes, count(distinct label) <> 2 as invalid_support, count(case when label not in (0, 1) then 1 end) > 0 as invalid_encoding from c
        union all select 'coded', count(*) - count(coded), count(distinct coded), count(distinct coded) <> 2, count(case when coded not in (0, 1) then 1 end) > 0 from c union all select 'text', 0, count(distinct o_orderstatus), count(distinct o_orderstatus) <> 2, true from c""",
    "a15_target_summary": f"""with {MESSY}, f as (select price from m where not isinf(price)) select count(*) as n, round(avg(price), 4) as mean, round(stddev_samp(price), 3) as sd, round(min(price), 4) as least, round(quantile_cont(price, 0.05), 4) as q05, round(quantile_cont(price, 0.5), 4) as median,
        round(quantile_cont(price, 0.95), 4) as q95, round(max(price), 4) as most, count(distinct price) as n_distinct, true as is_numeric, (select count(*) - count(price) from m) as n_missing, (select count(*) from m where isinf(price)) as n_infinite, count(distinct price) < 2 as invalid_support from f""",
    "a17_replicates": """with g as (select count(*) as n, count(distinct l_extendedprice) as v, stddev_samp(l_extendedprice) as sd, avg(l_extendedprice) as m from lineitem group by l_partkey, l_suppkey) select count(*) as n_groups, count(case when n > 1 then 1 end) as repeated_groups, 0::bigint as missing_rows,
        round(quantile_cont(sd, 0.5), 4) as median_sd, round(stddev_samp(m), 4) as sd_of_means, round(avg(case when n > 1 then (v > 1)::int end), 6) as conflicting_rate, 'ASSESSED' as status from g""",
    "a17_label_repeats": f"""with {ORDERS}, g as (select count(*) as n, count(distinct label) as v from o where unit is not null group by unit) select count(*) as n_groups, count(case when n > 1 then 1 end) as repeated_groups, (select count(*) from o where unit is null) as missing_rows,
        null::double as median_sd, null::double as sd_of_means, round(avg(case when n > 1 then (v > 1)::int end), 6) as conflicting_rate, 'NOT_ASSESSABLE' as status from g""",
    "a18_coverage": f"with {ORDERS} " + " union all ".join(f"select '{c}' as column_name, count(distinct {c}) as n_unique, count(*) - count({c}) as n_missing from o" for c in ("fold", "o_custkey", "o_orderpriority", "seen_at")),
    "a19_class_support": f"with {ORDERS} select o_orderstatus as class, count(distinct unit) + max(case when unit is null then 1 else 0 end) as n_units, true as by_unit from o group by 1 union all select o_orderstatus, count(*), false from o group by 1",
    "a25_o05_f10_measurements": f"""with {LINES}, d as (select *, log10(l_extendedprice / l_quantity) as ratio from ln where l_orderkey % 6 <> 0 and l_quantity > 0 and l_extendedprice > 0), f as (select l_suppkey, row_id from (select *, row_number() over (partition by l_suppkey order by l_returnflag, row_id) as place from d) where place = 1)
        select d.l_suppkey as key, any_value(f.row_id) as row_id, round(avg(ratio), 6) as mean, round(min(ratio), 6) as least, round(max(ratio), 6) as most, count(*) as n, string_agg(distinct l_returnflag, '|' order by l_returnflag) as all_l_returnflag,
        (select string_agg(q, '|' order by q) from (select distinct cast(cast(l_quantity as bigint) as varchar) as q from d e where e.l_suppkey = d.l_suppkey)) as all_l_quantity, (avg(ratio) >= 3.0)::int as label from d join f on f.l_suppkey = d.l_suppkey group by d.l_suppkey""",
    "a26_group_sizes": sizes_sql("events", "user_id, event_type"),
    "a27_d04_policy_exclude": f"with {ORDERS}, bad as (select o_custkey from o where lower(split) = 'train' group by 1 having count(distinct label) > 1) select o_orderkey, o_custkey, label from o where not (lower(split) = 'train' and o_custkey in (select o_custkey from bad))",
    "a27_d04_policy_aggregate": """with bad as (select o_custkey, min(o_orderkey) as k, avg(o_totalprice) as t from orders group by 1 having count(distinct o_totalprice) > 1)
        select o_orderkey, orders.o_custkey, o_orderstatus, round(coalesce(t, o_totalprice), 6) as o_totalprice from orders left join bad on bad.o_custkey = orders.o_custkey where k is null or k = o_orderkey""",
    "a27_majority_label": """with d as (select *, case when o_orderkey % 7 < 4 then 1 else 0 end as vote from orders), c as (select o_custkey, sum(vote) as a, count(*) as n, min(o_orderkey) as k from d group by 1 having 2 * sum(vote) <> count(*) and sum(vote) > 0 and sum(vote) < count(*))
        select o_orderkey, d.o_custkey, case when k is null then vote when 2 * a > n then 1 else 0 end as vote from d left join c on c.o_custkey = d.o_custkey where k is null or k = o_orderkey""",
    "a28_graph_counts": """select (select count(*) from lineitem) as n_rows, (select count(distinct l_suppkey) from lineitem) as n_units, (select count(*) from (select 1 from lineitem group by l_suppkey having count(distinct l_returnflag) > 1)) as units_with_several_graphs,
        (select count(*) from (select 1 from lineitem group by l_suppkey having count(distinct l_linestatus) > 1)) as units_with_several_targets, (select count(distinct l_returnflag) from lineitem) as n_graphs, (select count(*) from (select 1 from lineitem group by l_returnflag having count(distinct l_suppkey) > 1)) as shared_graphs""",
    "c12_conflict_summary": "select (select count(*) from (select 1 from orders group by o_custkey having count(distinct o_totalprice) > 1)) as targets, (select count(*) from (select 1 from orders group by o_custkey having count(distinct o_orderstatus) > 1)) as representations",
    "d02_f04_identifier_leakage": "select 'orderID' as feature, count(distinct o_orderkey) as n_unique, count(distinct o_orderkey) > 0.05 * count(*) as suspicious from orders union all select 'accessToken', count(distinct o_custkey), count(distinct o_custkey) > 0.05 * count(*) from orders union all select 'status_id', count(distinct o_orderstatus), count(distinct o_orderstatus) > 0.05 * count(*) from orders",
    "w06_w07_first_rows": f"with {ORDERS} select unit, o_orderkey, o_orderstatus from (select *, row_number() over (partition by unit order by o_orderkey) as place from o where unit is not null) where place = 1",
    "d01_d03_audit": f"""with {ORDERS}, s as (select o_custkey, count(*) as n, count(distinct o_totalprice) as t, count(distinct o_orderstatus) as r from o group by 1) select 'rows' as fact, count(*) as value from o union all select 'columns', 11 union all select 'duplicates', 0
        union all select 'missing:unit', count(*) - count(unit) from o union all select 'missing:seen_at', count(*) - count(seen_at) from o union all select 'n_ids:customer', count(*) from s union all select 'n_missing:customer', 0 union all select 'most:customer', max(n) from s
        union all select 'conflicting_targets:customer', count(case when t > 1 then 1 end) from s union all select 'conflicting_representations:customer', count(case when r > 1 then 1 end) from s union all select 'n_ids:priority', count(distinct o_orderpriority) from o union all select 'n_missing:priority', 0
        union all select 'most:priority', max(n) from (select count(*) as n from o group by o_orderpriority) union all select 'pairs', count(*) from (select distinct o_custkey, o_orderpriority from o) union all select 'warnings', 3 union all select 'suspicious', 0 union all select 'gaps', 1""",
    "d09_d10_findings": values_sql("position, status, code", [
        (0, "ACTION_REQUIRED", "unconfirmed_roles"), (1, "INFO", "declared_post_outcome_context"), (2, "WARNING", "missing_values"), (3, "WARNING", "repeated_entity:customer"), (4, "WARNING", "identity_conflict:customer"), (5, "WARNING", "repeated_entity:priority"),
        (6, "NOT_ASSESSABLE", "missing_high_value_metadata"), (7, "INFO", "declared_target_support"),
    ]),
    "d12_o07_readiness": values_sql("name, n_findings, n_blocking, n_limiting, readiness", [("declared", 6, 0, 5, "READY_WITH_LIMITS"), ("none_observed", 8, 1, 6, "BLOCKED")]),
    "d18_d19_guesses": values_sql("column_name, part, confirmed", [("o_orderkey", "numeric_target", False), ("o_custkey", "numeric_target", False), ("o_totalprice", "numeric_target", False), ("o_orderstatus", "categorical_target", False), ("o_orderpriority", "categorical_target", False)]),
    "d19_o06_cards": values_sql("position, family, target", [
        (0, "supervised_regression", "o_orderkey"), (1, "supervised_regression", "o_custkey"), (2, "supervised_regression", "o_totalprice"), (3, "supervised_classification", "o_orderstatus"), (4, "supervised_classification", "o_orderpriority"),
        (5, "dose_or_time_response", None), (6, "batch_confounding_audit", None), (7, "unsupervised_structure_exploration", None),
    ]),
    "d20_provisional_case": values_sql("target, kind, features, n_entities, n_unconfirmed", [("o_totalprice", "regression", "o_orderkey,o_custkey,o_orderstatus,o_orderdate,o_orderpriority", 0, 4)]),
    # --- partitions
    "x01_random_split": f"with {RANDOM} select * from part",
    "x02_group_split": f"with {ORDERS} {groups_sql('o', 'o_orderkey', 'unit', 11)}",
    "x03_cold_left": f"with {LINES} {groups_sql('ln', 'row_id', 'l_partkey', 23)}",
    "x04_cold_right": f"with {LINES} {groups_sql('ln', 'row_id', 'l_suppkey', 23)}",
    "x05_double_cold": f"""with {LINES}, d as (select *, case when l_partkey % 20 <> 0 then l_partkey end as part from ln), a as ({drawn(11, 'part', 'select distinct part from d where part is not null')}), b as ({drawn(11, 'l_suppkey', 'select distinct l_suppkey from d')}),
        e as (select row_id, coalesce(part in (select k from a where place <= greatest(1, round_even(0.25 * n, 0))), false) as x, l_suppkey in (select k from b where place <= greatest(1, round_even(0.25 * n, 0))) as y from d)
        select row_id, case when x and y then 'test' when not x and not y then 'train' else 'excluded' end as part from e""",
    "x06_w05_f06_time_split": f"with {ORDERS} select o_orderkey as row_id, case when row_number() over (order by seen_at nulls last, o_orderkey) <= round_even(0.75 * count(*) over (), 0) then 'train' else 'test' end as part from o",
    "x07_supplied_split": f"with {ORDERS} select o_orderkey as row_id, case split when 'Train' then 'train' when 'holdout' then 'test' else 'excluded' end as part from o",
    "x08_derived_groups": f"with g as (select *, substr(o_orderpriority, 1, 1) as letter from orders) {groups_sql('g', 'o_orderkey', 'letter', 7)}",
    "x09_f14_fingerprints": "select 2 as memberships, 3 as manifests, 64 as digits",
    "x10_nested_subsets": f"""with {ORDERS}, k as ({drawn(11, 'unit', 'select distinct unit from o where unit is not null')}) select f as fraction, count(distinct unit) as n_groups, count(*) as n_rows
        from (values (0.35::double), (0.65::double), (1.0::double)) as v(f), o join k on unit = k where place <= greatest(3, round_even(f * n, 0)) group by f""",
    "x12_permute_within_groups": f"""with {ORDERS}, g as (select coalesce(unit, -1) as g, count(*) as n, md5(concat('11|', coalesce(cast(any_value(unit) as varchar), ''))) as h from o group by 1), p as (select *, row_number() over (partition by n order by h, g) as place, count(*) over (partition by n) as peers from g),
        w as (select a.g as receiver, b.g as giver from p a join p b on a.n = b.n and b.place = a.place % a.peers + 1), src as (select coalesce(unit, -1) as g, o_totalprice, row_number() over (partition by coalesce(unit, -1) order by md5(concat('12|', o_orderkey)), o_orderkey) as k from o),
        dst as (select coalesce(unit, -1) as g, o_orderkey, row_number() over (partition by coalesce(unit, -1) order by o_orderkey) as k from o) select dst.o_orderkey as row_id, src.o_totalprice as permuted from dst join w on receiver = dst.g join src on src.g = giver and src.k = dst.k""",
    "x12_permute_rows": f"with a as ({drawn(11, 'o_orderkey', 'select o_orderkey from orders')}), b as ({drawn(12, 'o_orderkey', 'select o_orderkey from orders')}) select a.k as row_id, o_totalprice as permuted from a join b using (place) join orders on o_orderkey = b.k",
    "p03_development_rows": f"with {ORDERS} select o_orderkey as row_id, split = 'Train' and fold = 'train' as agreed from o where split = 'Train' or fold = 'train'",
    "p08_modelling_rows": f"with {ORDERS} select count(case when split <> 'other' or o_orderkey % 20 = 0 then 1 end) as n_used, count(case when split = 'other' and o_orderkey % 20 <> 0 then 1 end) as n_dropped from o",
    # --- overlap and claims
    "d05_u01_u02_u03_overlap": f"with {RANDOM}, j as (select * from orders join part on row_id = o_orderkey) {overlap_sql('j')}",
    "u02_j06_pair_overlap": f"with {LINES}, {RANDOM_LINES}, j as (select ln.*, part from ln join part on part.row_id = ln.row_id) {shared_sql('j', 'l_partkey, l_suppkey')}",
    "u04_c13_graph_overlap": f"with s as ({groups_sql('orders', 'o_orderkey', 'o_custkey', 11)}), j as (select o_orderstatus || (o_custkey % 400) as graph, part from orders join s on row_id = o_orderkey) {shared_sql('j', 'graph')}",
    "d07_u05_claims": values_sql("name, status", [("unseen_grouped", "COMPATIBLE"), ("unseen_halves", "INCOMPATIBLE"), ("same_halves", "COMPATIBLE"), ("same_grouped", "INCOMPATIBLE"), ("missing_ids", "NOT_ASSESSABLE"), ("no_claim", "NOT_ASSESSABLE")]),
    "a30_overlap_summary": "with " + ", ".join(f"r{s} as (select *, case when place <= ceil(0.25 * n) then 'test' else 'train' end as part from orders join ({drawn(s, 'o_orderkey', 'select o_orderkey from orders')}) on k = o_orderkey), g{s} as (select *, case when place <= ceil(0.25 * n) then 'test' else 'train' end as part from orders join ({drawn(s, 'o_custkey', 'select distinct o_custkey from orders')}) on k = o_custkey)" for s in (11, 23))
        + ", au as (" + " union all ".join(f"select '{n}' as scenario, * from ({overlap_sql(f'{t}{s}')})" for n, t in (("rows", "r"), ("customers", "g")) for s in (11, 23)) + """)
        select scenario, max(case when kind = 'record' then shared end) as exact, max(case when kind = 'pair' then shared end) as pairs, 0::bigint as expected_pairs, max(case when scenario = 'customers' and subject = 'customer' then shared else 0 end) as boundary, max(case when scenario = 'customers' and subject = 'customer' then test_fraction else 0 end) as boundary_fraction,
        max(case when subject = 'customer' then shared end) as unit, max(case when subject = 'customer' then test_fraction end) as unit_fraction, scenario = 'customers' as claim_compatible from au group by scenario""",
    "a30_class_floor": """with d as (select o_orderpriority as scenario, o_orderkey % 3 as seed, case when o_orderkey % 3 = 0 and o_orderstatus = 'P' then 'O' else o_orderstatus end as class, count(distinct o_custkey) as n from orders group by all),
        e as (select s.scenario, c.class, min(coalesce(d.n, 0)) as n from (select distinct scenario, seed from d) s join (select distinct scenario, class from d) c using (scenario) left join d on d.scenario = s.scenario and d.seed = s.seed and d.class = c.class group by all) select scenario, count(*) as n_classes, min(n) as least_class from e group by 1""",
    # --- features and scalar functions
    "f02_composition": "select p_partkey, " + ", ".join(f"round((length(p_name) - length(replace(upper(p_name), '{a}', ''))) / greatest(length(p_name), 1), 6) as share_{a.lower()}" for a in "ACDEFGHIKLMNPQRSTVWY") + " from part",
    "f22_feature_frames": values_sql("kind, n", [("char", 32), ("letters", 20), ("plain", 1)]),
    "f06_f07_p11_try_cast": "select o_orderkey, case when o_orderkey % 3 <> 0 then round(o_totalprice, 4) end as number, case when o_orderkey % 4 <> 0 then o_orderdate::date end as day from orders",
    "f08_f09_f13_mapping": "select 'order-' || o_orderkey as sample_id, case o_orderstatus when 'F' then 0 when 'O' then 1 when 'P' then 2 end as code, round(o_totalprice, 4) as price from orders",
    "f12_half_even": "select n_nationkey, round_even(n_nationkey * 0.5, 0)::bigint as half from nation",
    "w01_average_rank": f"select o_orderkey, v, {midrank('v')}::double as rank from (select o_orderkey, o_custkey % 997 as v from orders)",
    # --- adapters
    "s07_davis": "select count(*) as n, count(*) as ids, round(sum(l_extendedprice), 2) as total, (count(*) * (count(*) - 1) // 2)::bigint as numbers, count(distinct l_partkey) as compounds, count(distinct l_suppkey) as targets from lineitem",
    "s08_barrier": f"with {ORDERS} select label as bbb_label, count(*) as n, count(*) as ids from o group by 1",
    "s09_j02_u06_barrier_external": f"""with {ORDERS}, i as (select o_orderkey / 3 as k, label from o), e as (select c_custkey / 5 as k, case when c_acctbal > 0 then 1 else 0 end as label from customer)
        select 'train' as validation_split, label as bbb_label, count(*) as n, count(distinct k) as compounds, 0::bigint as grouped from i anti join e using (k) group by label union all select 'holdout', label, count(*), count(distinct k), count(*) from e group by label""",
    "s10_j03_tracer_external": """with d as (select 'P' || l_partkey as id, log10(l_quantity / l_extendedprice) as r, l_returnflag as f from lineitem where l_orderkey % 9 <> 0 and l_quantity > 0 and l_extendedprice > 0), p as (select 'd-' || p_partkey as s, 'P' || (p_partkey * 4) as id, p_partkey % 8 = 0 as tr from part),
        h as (select id, avg(r) as m, count(*) as n, string_agg(distinct f, '|' order by f) as a from d anti join p using (id) group by id)
        select s as sample_id, id as compound_id, 1 as bbb_label, 'train' as validation_split, null::double as log10_bb, null::bigint as measurement_count, null as source_animal_type from p where tr union all select 'petbd-' || id, id, (m >= -1.0)::int, 'holdout', round(m, 6), n, a from h""",
    "s11_a26_voice": """select count(*) as n, count(*) as ids, round(sum(l_quantity), 2) as age, count(distinct l_suppkey) as participants, (select count(*) from (select distinct l_suppkey, l_discount from lineitem)) as times,
        (select coalesce(sum(c), 0)::bigint from (select count(*) as c from lineitem group by l_suppkey, l_discount having count(*) > 1)) as repeated from lineitem""",
    # --- baselines, metrics
    "j01_m06_entity_means": f"with {MEANS} select row_id, y_true, round(global_mean, 6) as global_mean, round(left_mean, 6) as left_mean, round(right_mean, 6) as right_mean, round(additive, 6) as additive from pred",
    "m07_m08_m09_regression_metrics": f"""with {MEANS}, f as (select y_true as y, additive as p, {midrank('y_true')} as ry, {midrank('additive')} as rp from pred where additive is not null)
        select count(*) as n, round(avg(abs(y - p)), 4) as mae, round(sqrt(avg((y - p) * (y - p))), 4) as rmse, round({correlation('y', 'p')}, 5) as pearson, round({correlation('ry', 'rp')}, 5) as spearman from f""",
    "m08_flat_side": "select count(*) as n, round(avg(abs(o_totalprice - 1)), 2) as mae, round(sqrt(avg((o_totalprice - 1) * (o_totalprice - 1))), 2) as rmse, null::double as pearson, null::double as spearman from orders",
    "m10_kendall": """with f as (select row_number() over (order by o_orderkey) as i, o_totalprice as y, o_custkey % 50 + floor(o_totalprice / 20000) as p from orders), s as (select sum(sign(a.y - b.y) * sign(a.p - b.p)) as s, sum((a.y <> b.y)::int) as ny, sum((a.p <> b.p)::int) as np from f a join f b on a.i < b.i)
        select (select count(*) from f) as n, round(s / (sqrt(ny::double) * sqrt(np::double)), 6) as kendall_tau from s""",
    "m11_m14_p09_classification_metrics": f"""with {MESSY}, f as (select case when price > 150000 then 1.0 else 0.0 end as y, (key % 97) / 97.0::double as p from m where price is not null and key % 19 <> 0), f2 as (select y, p, {midrank('p')} as r, least(greatest(p, 1e-7), 1 - 1e-7) as c from f),
        g as (select p, sum(y) as h, count(*) as n from f group by p), u as (select h, sum(h) over (order by p desc) as tp, sum(n) over (order by p desc) as seen, sum(h) over () as pos from g)
        select count(*) as n, round((avg(case when y = 1 then (p >= 0.5)::int end) + avg(case when y = 0 then (p < 0.5)::int end)) / 2, 6) as balanced_accuracy, round((sum(case when y = 1 then r end) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) as roc_auc, (select round(sum(h / pos * tp / seen), 6) from u) as average_precision,
        round(avg(-(y * ln(c) + (1 - y) * ln(1 - c))), 6) as log_loss from f2""",
    "m12_m13_one_class": "with f as (select (o_custkey % 97) / 97.0::double as p from orders) select count(*) as n, round(avg((p >= 0.5)::int), 6) as balanced_accuracy, null::double as roc_auc, null::double as average_precision, round(avg(-ln(least(greatest(p, 1e-7), 1 - 1e-7))), 6) as log_loss from f",
    "m15_w04_group_ranking": f"""with f as (select o_custkey % 50 as grp, o_totalprice as y, o_custkey % 7 as p from orders), w as (select grp, p, y - min(y) over (partition by grp) as rel, row_number() over (partition by grp order by p desc) as place, row_number() over (partition by grp order by y desc) as ideal, {midrank('y', 'grp')} as a, {midrank('p', 'grp')} as b from f),
        x as (select *, avg(rel) over (partition by grp, p) as gain from w), s as (select grp, {correlation('a', 'b')} as rho, sum(case when place <= 10 then gain / ln(place + 1) end) / nullif(sum(case when ideal <= 10 then rel / ln(ideal + 1) end), 0) as ndcg from x group by grp having count(*) >= 2)
        select count(*) as n_groups, round(quantile_cont(rho, 0.5), 5) as median_spearman, round(quantile_cont(ndcg, 0.5), 5) as median_ndcg from s""",
    "m16_permutation_summary": """with d as (select avg(o_totalprice) as v from orders where o_custkey % 99 <> 5 group by o_custkey % 99), x as (select avg(o_totalprice) as o from orders)
        select count(*) as draws, round(quantile_cont(v, 0.5), 4) as median, round(quantile_cont(v, 0.05), 4) as q05, round(quantile_cont(v, 0.95), 4) as q95, round((1 + count(case when v >= o then 1 end)) / (1 + count(*)), 6) as p_value from d, x""",
    "m17_m18_directions": values_sql("metric, direction, ranking_sign", [("mae", -1, -1), ("rmse", -1, 1), ("log_loss", -1, 1), ("spearman", 1, 1), ("roc_auc", 1, 1)]),
    "m04_m05_suites": values_sql("suite, name", [(0, "dummy"), (0, "logistic"), (0, "extra_trees"), *((1, n) for n in ("dummy", "elastic_net", "extra_trees", "hist_gradient_boosting", "nearest_neighbour")), (2, "dummy"), (2, "nearest_neighbour"), (9, "5"), (9, "3")]),
    "m01_preparation": f"""with {ORDERS}, d as (select *, case when o_orderkey % 5 <> 0 then o_custkey::double end as gap, case when o_orderkey % 8 <> 0 then o_orderstatus end as kind from o), t as (select * from d where split = 'Train'), k as (select kind, row_number() over (order by count(*) desc, kind) as place from t where kind is not null group by kind)
        select o_orderkey, coalesce(gap, (select quantile_cont(gap, 0.5) from t)) as gap, (coalesce(kind, (select kind from k where place = 1)) = (select kind from k where place = 1))::int::double as first, (coalesce(kind, (select kind from k where place = 1)) = (select kind from k where place = 2))::int::double as second,
        (coalesce(kind, (select kind from k where place = 1)) = (select kind from k where place = 3))::int::double as third from d where split = 'holdout'""",
    "m02_m03_dummy": f"with {ORDERS} select o_orderkey, (select round(avg(o_totalprice), 4) from o where split = 'Train') as y_pred from o where split = 'holdout'",
    "m03_elastic_net": f"with {ORDERS} select count(*) as n, true as close from o where split = 'holdout'",
    "m21_m22_predictions": f"with {ORDERS} select o_orderkey as _row_id, round(o_totalprice, 4) as y_true, o_custkey::double as y_pred, split = 'holdout' as is_test, 'r' as run_id, 'given' as scenario, 'dummy' as model, 'declared_features' as representation from o where split <> 'other'",
    # --- experiments
    "a20_experiment_summary": f"with {RECORDS} select scenario, representation, model, permuted, round(quantile_cont(v, 0.5), 6) as median, round(coalesce(stddev_samp(v), 0), 6) as sd, count(*) as runs, count(v) as finite_runs from rec group by all",
    "a21_p10_best_model": f"with {RECORDS}, p as (select scenario, model, quantile_cont(v, 0.5) as median from held group by all) select scenario, model, round(median, 6) as median from (select *, row_number() over (partition by scenario order by median desc, model) as place from p) where place = 1",
    "a22_t02_partition_variation": f"with {RECORDS} select *, case when median_sd is not null then 'ASSESSED' else 'NOT_ASSESSABLE' end as status from ({partition_sql('held')})",
    "t02_unrecorded_partitions": "select null::bigint as distinct_partitions, null::double as median_sd, 'NOT_ASSESSABLE' as status",
    "a23_t03_decomposition": f"""with {RECORDS}, u as (select * from held where v is not null) select 'train_validation_split' as axis, 'ASSESSED' as status, median_sd as sd from ({partition_sql('held')})
        union all select 'model_family', 'ASSESSED', round(quantile_cont(sd, 0.5), 6) from (select stddev_samp(v) as sd from u group by scenario, representation, seed) union all select 'molecular_representation', 'ASSESSED', round(quantile_cont(sd, 0.5), 6) from (select stddev_samp(v) as sd from u group by scenario, seed, model)
        union all select 'deployment_scenario', 'ASSESSED', round(stddev_samp(m), 6) from (select quantile_cont(v, 0.5) as m from u group by scenario) union all select 'training_initialization', 'NOT_ASSESSABLE', null union all select 'preprocessing', 'NOT_ASSESSABLE', null""",
    "a24_representation_range": f"with {RECORDS}, p as (select scenario, model, representation, quantile_cont(v, 0.5) as m from held group by all having count(v) > 0) select scenario, model, round(max(m) - min(m), 6) as range from p group by all having count(*) = 2",
    "t04_representation_sensitivity": f"""with {RECORDS}, p as (select scenario, model, representation, quantile_cont(v, 0.5) as m from held group by all having count(v) > 0), r as (select scenario, max(m) - min(m) as r from p group by scenario, model having count(*) = 2)
        select v.*, (select round(max(r), 6) from r where r.scenario = v.scenario) as matched_range from (values ('rows', true, 0.3::double, 'CONTRADICTED'), ('customers', false, 0.0::double, 'SUPPORTED_WITH_LIMITS')) as v(scenario, verdict_changes, median_range, conservative_status)""",
    "w02_rank_spread": f"with {RANKINGS}, s as (select stddev_samp(k) as sd from (select *, rank() over (partition by run, grp order by score desc) + (count(*) over (partition by run, grp, score) - 1) / 2 as k from r) group by grp, candidate) select round(quantile_cont(sd, 0.5), 6) as median_rank_sd, count(sd) as n from s",
    "w03_o04_top_k": f"with {RANKINGS}, {top_sql(5)} select * from t",
    "t01_u10_selection_probability": f"with {RANKINGS}, {top_sql(5)}, n as (select grp, count(distinct run) as runs from t group by grp) select grp, candidate, runs, round(c / runs, 6) as probability from (select grp, candidate, count(*) as c from t group by all) join n using (grp)",
    "u08_j07_pairwise_jaccard": f"""with {RANKINGS}, {top_sql(5, 'asc')}, s as (select run, grp, list(candidate) as l from t group by all)
        select a.grp, a.run as run_a, b.run as run_b, round(len(list_intersect(a.l, b.l)) / len(list_distinct(list_concat(a.l, b.l))), 6) as jaccard from s a join s b on a.grp = b.grp and a.run < b.run""",
    "t05_u07_ranking_results": f"with {RANKINGS} " + " union all ".join(ranking_sql(f"select * from r{w}", k, n) for n, w in (("null", ""), ("'x'", " where candidate % 2 = 0"), ("'y'", " where candidate % 2 <> 0")) for k in (3, 5)),
    # --- verdicts
    "c01_scenario_facts": FACTS,
    "c01_c02_c03_c04_c06_verdicts": values_sql("name, metric_status, status, capped_by", [
        ("at_supported", "SUPPORTED", "SUPPORTED", ""), ("below_supported", "SUPPORTED_WITH_LIMITS", "SUPPORTED_WITH_LIMITS", ""), ("at_limited", "SUPPORTED_WITH_LIMITS", "SUPPORTED_WITH_LIMITS", ""), ("below_limited", "INSUFFICIENT_EVIDENCE", "INSUFFICIENT_EVIDENCE", ""),
        ("unsteady", "SUPPORTED_WITH_LIMITS", "SUPPORTED_WITH_LIMITS", ""), ("one_run", "SUPPORTED", "SUPPORTED", ""), ("no_metric", "NOT_ASSESSABLE", "NOT_ASSESSABLE", ""), ("refuted", "CONTRADICTED", "CONTRADICTED", ""), ("not_refuted_at_random", "INSUFFICIENT_EVIDENCE", "INSUFFICIENT_EVIDENCE", ""),
        ("weak_delta", "INSUFFICIENT_EVIDENCE", "INSUFFICIENT_EVIDENCE", ""), ("weak_p", "INSUFFICIENT_EVIDENCE", "INSUFFICIENT_EVIDENCE", ""), ("no_null", "INSUFFICIENT_EVIDENCE", "INSUFFICIENT_EVIDENCE", ""),
        *((n, "SUPPORTED", "SUPPORTED_WITH_LIMITS", "conflicts_or_overlap") for n in ("exact", "pairs", "boundary", "targets", "representations")), ("unclaimed", "SUPPORTED", "NOT_ASSESSABLE", "claim"), ("few", "SUPPORTED", "INSUFFICIENT_EVIDENCE", "class_floor"),
        ("one_class", "SUPPORTED", "INSUFFICIENT_EVIDENCE", "class_floor"), ("repeats", "SUPPORTED", "SUPPORTED_WITH_LIMITS", "repeated_units"), ("few_refuted", "CONTRADICTED", "CONTRADICTED", "class_floor"),
    ]),
    "c05_top_k_verdict": values_sql("mean_jaccard, status", [(None, "NOT_ASSESSABLE"), (0.49, "INSUFFICIENT_EVIDENCE"), (0.5, "SUPPORTED_WITH_LIMITS"), (0.64, "SUPPORTED_WITH_LIMITS"), (0.65, "SUPPORTED")]).replace("select *", "select mean_jaccard::double as mean_jaccard, status"),
    "c07_c08_c10_verdict_matrix": values_sql("claim, representation, status, median, warned", [
        ("rows", "x", "SUPPORTED", 0.5, True), ("rows", "y", "CONTRADICTED", 0.4, True), ("top-3 selection within priority", "x", "SUPPORTED_WITH_LIMITS", None, True), ("top-3 selection within priority", "y", "SUPPORTED_WITH_LIMITS", None, True),
        ("measurement reliability", None, "SUPPORTED_WITH_LIMITS", None, True), ("batch confounding", None, "NOT_ASSESSABLE", None, True), ("temporal generalization", None, "NOT_ASSESSABLE", None, True),
    ]).replace("select *", "select claim, representation, status, median::double as median, warned"),
    "c09_permutation_design": values_sql("name, method, unit", [("a", "row", None), ("b", "equal_size_group_blocks_within_group_shuffle", "u"), ("c", "mixed", None), ("d", "unrecorded", None), ("e", "equal_size_group_blocks_within_group_shuffle", None), ("f", "unrecorded", None)]),
    "c11_graph_readiness": values_sql("name, status", [
        ("ready", "READY_FOR_BOUNDED_PROBE"), ("undeclared", "NOT_ASSESSABLE"), ("unmet", "NOT_READY_DATA_LIMITED"), ("no_verdict", "NOT_ASSESSABLE"), ("no_overlap", "NOT_ASSESSABLE"), ("crossing", "NOT_READY_DATA_LIMITED"), ("support", "NOT_READY_DATA_LIMITED"),
        ("external", "NOT_JUSTIFIED_BY_CURRENT_EVIDENCE"), ("enough", "FEASIBLE_BUT_LOW_PRIORITY"), ("no_change", "NOT_JUSTIFIED_BY_CURRENT_EVIDENCE"), ("no_gap", "NOT_JUSTIFIED_BY_CURRENT_EVIDENCE"),
    ]),
    "c13_overlap_status": values_sql("name, n_partitions, worst, enough, status", [("ok", 2, 3, True, "ASSESSED"), ("floor", 2, 3, False, "ASSESSED"), ("unit", 2, 3, True, "NOT_ASSESSABLE")]),
    "c14_c15_summaries": values_sql("name, n_verdicts, all_limited, bounded_gap, changes, matched_range, curve_rows, null_failure", [("a", 2, True, True, False, 0.1, 2, True), ("ab", 3, False, True, True, 0.3, 2, True), ("bc", 2, False, False, True, 0.3, 0, True)]).replace("select *", "select * replace (matched_range::double as matched_range)"),
    "b03_decisions": values_sql("name, decision, because", [
        ("better", "KEEP", "all rules"), ("first", "KEEP", "first"), ("guarded", "DISCARD", "guardrails"), ("slow", "DISCARD", "runtime"), ("same", "DISCARD", "gain"), ("worse_scenario", "DISCARD", "worst scenario"), ("unstable", "DISCARD", "stability"), ("lower", "KEEP", "all rules"), ("unknown", "DISCARD", "gain"),
    ]),
}
