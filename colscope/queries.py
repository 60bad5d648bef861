"""Registered queries of the profiling engine, each with SQL that another engine can run on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import DataProfiler
from .functions import exprs
from .operators import relate, semantic
from .operators.compare import DataComparator
from .operators.relate import RelationshipAnalyzer
from .plans.kernel import duplicate_rows, share, table
from .streaming.windows import windowed_quality

# Sources are SQL that both engines run. Holes and repeats are edited in, as the tables have none.
SOURCES = {
    "lineitem": "select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate from lineitem",
    "orders": "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders",
    "holes": "select o_orderkey, case when o_orderkey % 7 = 0 then null else o_totalprice end as o_totalprice, case when o_orderkey % 5 = 0 then null when o_orderkey % 11 = 0 then '' when o_orderkey % 13 = 0 then concat(' ', o_orderpriority) else o_orderpriority end as o_orderpriority, case when o_orderkey % 3 = 0 then -o_custkey else o_custkey end as o_custkey from orders",
    "customer": "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer",
    "supplier": "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier",
    "part": "select p_partkey, p_name, p_brand, p_type, p_size, p_retailprice from part",
    "events": "select event_id, ts, user_id, event_type, value, props from events",
    "documents": "select doc_id, text, lang, source, n_chars from documents",
    "labels": "select doc_id, quality, toxic from labels",
    "talks": "select conv_id, turn, role, text from conversations",
    "flags": "select l_returnflag, l_linestatus from lineitem",
    "derived": "select l_extendedprice, l_discount, l_extendedprice * (1 - l_discount) as revenue, 1 as one, l_quantity from lineitem",
    "after": "select o_orderkey + 1 as o_orderkey, case when o_orderkey % 14 = 0 then null else o_totalprice + 1 end as o_totalprice, case when o_orderkey % 10 = 0 then null else o_orderpriority end as o_orderpriority, 1 as added from orders",
    # every kind of personal data, with holes and some values that aren't
    "contacts": "select c_custkey, case when c_custkey % 9 = 0 then null else concat('user', c_custkey, '@example.com') end as mail, concat('+91 ', cast(9000000000 + c_custkey as varchar(10))) as reach, case when c_custkey % 20 = 0 then 'none' else concat('1234 5678 ', lpad(cast(c_custkey % 10000 as varchar(10)), 4, '0')) end as uid, concat('ABCDE', lpad(cast(c_custkey % 10000 as varchar(10)), 4, '0'), 'F') as tax, case when c_custkey % 10 = 0 then 'none' else concat('10.', c_custkey % 256, '.', c_custkey % 7, '.1') end as host, concat(' Ann ', c_mktsegment, ' ') as who, concat(c_custkey, ' Main Street') as home from customer",
    "prices": "select l_linenumber, l_quantity, l_extendedprice, l_discount, -l_extendedprice * l_extendedprice as cost, case when l_linenumber > 5 then null else l_quantity * l_quantity end as square from lineitem",
}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = SOURCES[name]
    for t in ("lineitem", "orders", "customer", "supplier", "part", "events", "documents", "labels", "conversations", "nation", "region"):
        if f"from {t}" in sql:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"colscope_{t}")
            sql = sql.replace(f"from {t}", f"from colscope_{t}")
    return spark.sql(sql)


# (column, family, Spark type) of each source; n: numeric, s: text
COLUMNS = {
    "lineitem": "l_orderkey n bigint,l_partkey n bigint,l_suppkey n bigint,l_linenumber n int,l_quantity n double,l_extendedprice n double,l_discount n double,l_tax n double,l_returnflag s string,l_linestatus s string,l_shipdate s timestamp_ntz",
    "orders": "o_orderkey n bigint,o_custkey n bigint,o_orderstatus s string,o_totalprice n double,o_orderdate s timestamp_ntz,o_orderpriority s string",
    "holes": "o_orderkey n bigint,o_totalprice n double,o_orderpriority s string,o_custkey n bigint",
    "customer": "c_custkey n bigint,c_name s string,c_nationkey n int,c_acctbal n double,c_mktsegment s string",
    "supplier": "s_suppkey n bigint,s_name s string,s_nationkey n int,s_acctbal n double",
    "part": "p_partkey n bigint,p_name s string,p_brand s string,p_type s string,p_size n int,p_retailprice n double",
    "events": "event_id n bigint,ts s timestamp_ntz,user_id n bigint,event_type s string,value n double,props s string",
    "documents": "doc_id n bigint,text s string,lang s string,source s string,n_chars n bigint",
    "labels": "doc_id n bigint,quality n int,toxic n int",
    "talks": "conv_id n bigint,turn n bigint,role s string,text s string",
    "contacts": "c_custkey n bigint,mail s string,reach s string,uid s string,tax s string,host s string,who s string,home s string",
}
_WIDTH = {"bigint": 8, "int": 4, "double": 8, "float": 4, "smallint": 2, "tinyint": 1}
_WS = r"[ \t\n\r\x0b\f]"


def columns(name: str) -> list[tuple[str, str, str]]:
    return [tuple(c.split(" ")) for c in COLUMNS[name].split(",")]  # type: ignore[misc]


def base_sql(name: str) -> str:
    """One row per column with everything that the sections need."""
    parts = []
    for i, (c, fam, kind) in enumerate(columns(name), 1):
        freq = f"(select count(*) as u, max(k) as mf from (select {c} as v, count(*) as k from src where {c} is not null group by 1))"
        mode = f"(select cast(v as varchar) from (select {c} as v, count(*) as k from src where {c} is not null group by 1) order by k desc, v limit 1)"
        if fam == "n":
            x = f"cast({c} as double)"
            b = f"(select avg({x}) as m, stddev_samp({x}) as s, quantile_cont({x}, 0.25) as a, quantile_cont({x}, 0.75) as z from src)"
            num = (
                f"count({c}) * {_WIDTH[kind]} as bytes, min({x}) as mn, max({x}) as mx, avg({x}) as av, stddev_samp({x}) as sd, var_samp({x}) as vr, "
                f"case when count({c}) < 3 then null when var_samp({x}) = 0 then 0 else skewness({x}) end as sk, case when count({c}) < 4 then null when var_samp({x}) = 0 then 0 else kurtosis({x}) end as ku, "
                + ", ".join(f"quantile_cont({x}, {q}) as {n}" for q, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"), (0.95, "p95"), (0.99, "p99")))
                + f", case when min({x}) > 0 then exp(avg(case when {x} > 0 then ln({x}) end)) end as geo, case when min({x}) > 0 then count({c}) / sum(case when {x} > 0 then 1 / {x} end) end as har, sqrt(avg({x} * {x})) as rms, "
                f"count(*) filter (where {x} = 0) as ze, count(*) filter (where {x} < 0) as ne, 0 as inf, "
                f"count(*) filter (where {x} < b.a - 1.5 * (b.z - b.a) or {x} > b.z + 1.5 * (b.z - b.a)) as ou, avg(abs({x} - b.m)) as mad, count(*) filter (where b.s > 0 and abs(({x} - b.m) / b.s) > 3) as zo, 0 as sp, 0 as em, 0 as spec, 0 as nl"
            )
            frm = f"src cross join {b} b"
        else:
            x = c if kind == "string" else f"cast({c} as varchar)"
            size = f"coalesce(sum(strlen({c})), 0)" if kind == "string" else f"count({c}) * 8"
            null = ", ".join(f"cast(null as double) as {n}" for n in "mn mx av sd vr sk ku q1 q2 q3 p95 p99 geo har rms".split())
            num = (
                f"{size} as bytes, {null}, 0 as ze, 0 as ne, 0 as inf, 0 as ou, cast(null as double) as mad, 0 as zo, count(*) filter (where regexp_matches({x}, '^{_WS}|{_WS}$')) as sp, "
                f"count(*) filter (where {x} = '') as em, count(*) filter (where regexp_matches({x}, '[^a-zA-Z0-9 \\t\\n\\r\\x0b\\f]')) as spec, "
                f"count(*) filter (where regexp_matches(regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g'), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')) as nl"
            )
            frm = "src"
        parts.append(f"select {i} as pos, '{c}' as \"column\", '{kind}' as dtype, '{fam}' as fam, (select count(*) from src) as n, t.*, f.u, coalesce(f.mf, 0) as mf, {mode} as mode from (select count({c}) as nn, {num} from {frm}) t cross join {freq} f")
    return f"with src as ({SOURCES[name]}), base as (" + " union all ".join(parts) + "), st as (select *, n - nn as mi, n - u - (case when n > nn then 1 else 0 end) as du, coalesce(round(ou * 100.0::double / nullif(n, 0), 2), 0) as op, coalesce(round(u * 100.0::double / nullif(n, 0), 2), 0) as up, coalesce(round((n - nn) * 100.0::double / nullif(n, 0), 2), 0) as mp, coalesce(round((n - u - (case when n > nn then 1 else 0 end)) * 100.0::double / nullif(n, 0), 2), 0) as dp from base) "


def _num(expr: str) -> str:
    return f"case when fam = 'n' then {expr} end"


SECTION_SQL = {
    "schema": 'select pos as position, "column", dtype, nn as non_null_count, mi as missing_count, mp as missing_pct, u as unique_count, up as unique_pct, cast(bytes as bigint) as memory_bytes from st',
    "statistics": 'select "column", dtype, nn as count, mi as missing_count, round(av,4) as mean, round(q2,4) as median, round(sd,4) as std, round(mn,4) as min, round(q1,4) as q1, round(q2,4) as q2, round(q3,4) as q3, round(p95,4) as p95, round(p99,4) as p99, round(mx,4) as max, round(mx-mn,4) as range, round(q3-q1,4) as iqr, round(sk,4)+0.0 as skewness, round(ku,4)+0.0 as kurtosis, mode, mf as mode_frequency, round(geo,4) as geometric_mean, round(har,4) as harmonic_mean, round(rms,4) as rms, case when av <> 0 then round(sd/abs(av)*100,4) end as cv_pct, round(mad,4) as mad, ' + _num("zo") + " as z_outlier_count from st",
    "quality": f'select "column", du as duplicate_count, mi as missing_count, {_num("ze")} as zero_count, {_num("ou")} as outlier_count, {_num("op")} as outlier_pct from st',
    "ml": "select \"column\", dtype, case when fam='n' then 'Numeric' else 'Categorical' end as feature_type, u as unique_count, up as unique_pct, mp as missing_pct, round(vr,4) as variance, round(sk,4)+0.0 as skewness, " + _num("op") + " as outlier_pct, case when fam='n' then null when u <= 10 then 'Low' when u*100.0/n < 50 then 'Medium' else 'High' end as cardinality, case when fam='n' then null when u <= 10 then 'OneHot Encoding' when u*100.0/n < 50 then 'Target Encoding' else 'Hash Encoding' end as encoding_suggestion, " + _num("case when op > 5 then 'RobustScaler' else 'StandardScaler' end") + " as scaling_suggestion, " + _num("case when abs(sk) > 1 then 'Log Transform' else 'None' end") + " as transformation, case when vr = 0 then 'Constant Feature' when u*100.0/n > 95 then 'Possible ID' else 'Good' end as feature_status from st",
    "etl": "select \"column\", dtype, n as rows, mi as missing_count, mp as missing_pct, u as unique_count, up as unique_pct, du as duplicate_count, dp as duplicate_pct, coalesce(nullif(concat_ws(', ', case when mi>0 then 'Missing Values' end, case when du>0 then 'Duplicate Values' end, case when ne>0 then 'Negative Values' end, case when ou>0 then 'Outliers' end, case when sp>0 then 'Extra Spaces' end, case when em>0 then 'Empty String' end), ''), 'None') as issue, mi + du as issue_count, case when du>0 then 'Remove Duplicates' when mi>0 then 'Impute Values' else 'No Action' end as recommended_action, case when mi+du+ne+ou+sp+em > 0 then 'Needs Cleaning' else 'Ready' end as etl_status, " + ", ".join(f"{_num(a)} as {b}" for a, b in (("ne", "negative_count"), ("ze", "zero_count"), ("ou", "outlier_count"), ("op", "outlier_pct"))) + ", " + ", ".join(f"case when fam='s' then {a} end as {b}" for a, b in (("sp", "space_issue_count"), ("em", "empty_string_count"), ("spec", "special_character_count"))) + " from st",
}
_SCORED = "sc as (select *, round(100-mp,2) as s1, round(100-dp,2) as s2, case when fam='n' then round(100-op,2) else 100 end as s3, case when fam='n' then 100.0 when nn>0 and nl*1.0/nn > 0.8 then greatest(0, round(100-round(nl*100.0::double/nn,2),2)) else 100.0 end as s4, case when fam='n' then 100.0 else round(100-least(coalesce(round((sp+em+spec)*100.0::double/nullif(n,0),2),0),100),2) end as s5 from st)"


def section_query(name: str, section: str) -> tuple[Callable, str]:
    return (lambda spark, sf: DataProfiler(source(spark, sf, name)).info_dataframe(section)), base_sql(name) + SECTION_SQL[section]


def score_query(name: str, w: dict[str, float] | None, by: str) -> tuple[Callable, str]:
    full = dict.fromkeys(("missing", "duplicates", "outliers", "dtypes", "invalid"), 20.0) | (w or {})
    total = sum(full.values())
    ws = [v / total * 100 for v in full.values()]
    mix = lambda cols: "round((" + " + ".join(f"{c} * {k!r}::double" for c, k in zip(cols, ws, strict=True)) + ") / 100, 2)"
    head = base_sql(name).rstrip() + ", " + _SCORED
    if by == "column":
        sql = head + f' select "column", dtype, s1 as missing_score, s2 as duplicate_score, cast(s3 as double) as outlier_score, cast(s4 as double) as data_type_score, cast(s5 as double) as invalid_score, {mix(["s1", "s2", "s3", "s4", "s5"])} as quality_score from sc'
    else:
        sql = head + ", al as (select round(avg(s1),2) as a1, (select round(100 - round((count(*) - (select count(*) from (select distinct * from src))) * 100.0::double / count(*), 2), 2) from src) as a2, round(avg(s3),2) as a3, round(avg(s4),2) as a4, round(avg(s5),2) as a5 from sc) "
        names = ["Missing Score", "Duplicate Score", "Outlier Score", "Data Type Score", "Invalid Values Score"]
        sql += f"select 'Overall Quality Score' as metric, {mix(['a1', 'a2', 'a3', 'a4', 'a5'])} as score from al" + "".join(f" union all select '{m}', cast(a{i} as double) from al" for i, m in enumerate(names, 1))
    return (lambda spark, sf: DataProfiler(source(spark, sf, name)).quality_score(by=by, weights=w)), sql


# PII -----------------------------------------------------------------------------------------------------------------
def pii_sql(name: str, least: float = 60) -> str:
    word, octet = r"[A-Za-z][A-Za-z''.\-]*", r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    words = "|".join(w.replace(".", r"\.") for w in exprs.ADDRESS_WORDS)
    parts = []
    for i, (c, _, _) in enumerate(columns(name)):
        d = r"regexp_replace(t, '[ \t\n\r\x0b\f()\-]', '', 'g')"
        phone = f"(case when {d} like '+91%' then substr({d}, 4) when {d} like '91%' and length({d}) = 12 then substr({d}, 3) when {d} like '+%' then substr({d}, 2) else {d} end)"
        tests = {
            "EMAIL": r"regexp_full_match(t, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}')",
            "PHONE": f"regexp_full_match({phone}, '[6-9][0-9]{{9}}|[0-9]{{10,13}}')",
            "POSSIBLE_ID": r"regexp_full_match(t, '[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}')",
            "POSSIBLE_PAN": "regexp_full_match(t, '[A-Z]{5}[0-9]{4}[A-Z]')",
            "IP": rf"regexp_full_match(t, '{octet}\.{octet}\.{octet}\.{octet}')",
            "POSSIBLE_NAME": rf"(length(t) <= 40 and regexp_full_match(t, '{word}(\s+{word}){{1,3}}'))",
            "POSSIBLE_ADDRESS": f"(length(t) >= 8 and regexp_matches(t, '[0-9]') and (regexp_matches(lower(t), '{words}') or contains(t, ',')))",
        }
        for k, (kind, test) in enumerate(tests.items()):
            bonus = 10 if any(h in c.lower() for h in exprs.NAME_HINTS[kind]) else 0
            parts.append(f"select {i} as pos, {k} as k, '{c}' as \"column\", '{kind}' as pii_type, least(100, count(*) filter (where {test}) * 100.0::double / count(*) + {bonus}) as p from (select regexp_replace(cast({c} as varchar), '^{_WS}+|{_WS}+$', '', 'g') as t from src) where t <> '' having count(*) > 0")
    return f"with src as ({SOURCES[name]}), a as (" + " union all ".join(parts) + f") select \"column\", pii_type, round(p, 2) as confidence_pct from (select *, row_number() over (partition by pos order by p desc, k) as r from a) where r = 1 and p >= {least} and p > 0"


def pii_query(name: str, least: float = 60) -> tuple[Callable, str]:
    return (lambda spark, sf: DataProfiler(source(spark, sf, name)).pii(least)), pii_sql(name, least)


def mask_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DataProfiler(source(spark, sf_dir, "contacts")).pii(mask=True)


MASK_TABLE_SQL = (
    "select c_custkey, case when mail is not null then concat(substr(mail, 1, 1), repeat('*', cast(greatest(1, strpos(mail, '@') - 2) as bigint)), substr(mail, strpos(mail, '@'))) end as mail, concat('91********', right(reach, 2)) as reach, case when uid = 'none' then '****' else concat('********', right(uid, 4)) end as uid, concat('AB*******', right(tax, 1)) as tax, "
    "case when strpos(host, '.') > 0 then concat(regexp_replace(host, '[.][^.]*$', '.'), '***') else repeat('*', length(host)) end as host, concat('A** ', substr(trim(who), 5, 1), repeat('*', length(trim(who)) - 5)) as who, '[REDACTED ADDRESS]' as home "
    f"from ({SOURCES['contacts']})"
)


MASKED = [("john.doe@gmail.com", "9876543210", "1234 5678 9012", "ABCDE1234F", "192.168.1.1", "Rahul Sharma", "12 Main Street"), (None,) * 7]
MASK_KINDS = ("EMAIL", "PHONE", "POSSIBLE_ID", "POSSIBLE_PAN", "IP", "POSSIBLE_NAME", "POSSIBLE_ADDRESS")


def mask_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame(MASKED, ", ".join(f"c{i} string" for i in range(7)))
    return df.select(*(exprs.mask(F.col(f"c{i}"), k).alias(k.lower()) for i, k in enumerate(MASK_KINDS)))


MASK_SQL = "select * from (values ('j*******@gmail.com', '98******10', '********9012', 'AB*******F', '192.168.1.***', 'R**** S*****', '[REDACTED ADDRESS]'), (null, null, null, null, null, null, null)) t(" + ", ".join(k.lower() for k in MASK_KINDS) + ")"


# correlations --------------------------------------------------------------------------------------------------------
def numeric(name: str) -> list[str]:
    return [c for c, f, _ in columns(name) if f == "n"] if name in COLUMNS else ["l_extendedprice", "l_discount", "revenue", "one", "l_quantity"]


def _corr(a: str, b: str) -> str:
    a, b = f"cast({a} as double)", f"cast({b} as double)"
    return f"round(regr_sxy({b}, {a}) / nullif(sqrt(regr_sxx({b}, {a}) * regr_syy({b}, {a})), 0), 4) + 0.0"


def corr_query(name: str, method: str = "pearson", by: str = "pairs", threshold: float | None = None, only: list[str] | None = None) -> tuple[Callable, str]:
    cols = only or numeric(name)
    src = f"(select {', '.join(cols)} from ({SOURCES[name]}))"
    if method == "spearman":
        src = "(select " + ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as {c}" for c in cols) + f" from {src})"
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    if by == "pairs":
        sql = " union all ".join(f"select '{a}' as column_a, '{b}' as column_b, {_corr(a, b)} as correlation from {src}" for a, b in pairs)
        sql = f"select column_a, column_b, correlation, round(correlation * correlation, 4) as r_squared from ({sql}) where correlation is not null" + (f" and abs(correlation) >= {threshold}" if threshold else "")
    else:
        cell = lambda a, b: (f"case when var_samp({a}) > 0 then 1.0::double end" if a == b else _corr(*((a, b) if cols.index(a) < cols.index(b) else (b, a)))) + f" as {b}"
        sql = " union all ".join(f"select '{a}' as \"column\", " + ", ".join(cell(a, b) for b in cols) + f" from {src}" for a in cols)
    return (lambda spark, sf: DataProfiler(source(spark, sf, name).select(*cols)).correlations(method, by, threshold)), sql


def kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DataProfiler(source(spark, sf_dir, "part").select("p_size", "p_retailprice")).correlations("kendall", "pairs")


KENDALL_SQL = (
    "with c as (select p_size as x, p_retailprice as y, count(*) as n from part group by all), q as (select sum(case when (a.x - b.x) * (a.y - b.y) > 0 then a.n * b.n when (a.x - b.x) * (a.y - b.y) < 0 then -a.n * b.n else 0 end) / 2.0 as s from c a, c b), "
    "m as (select sum(n) * (sum(n) - 1) / 2.0 as p from c), tx as (select sum(k * (k - 1) / 2.0) as t from (select sum(n) as k from c group by x)), ty as (select sum(k * (k - 1) / 2.0) as t from (select sum(n) as k from c group by y)), "
    "r as (select round(s / sqrt((p - tx.t) * (p - ty.t)), 4) as v from q, m, tx, ty) select 'p_size' as column_a, 'p_retailprice' as column_b, cast(v as double) as correlation, round(cast(v as double) * cast(v as double), 4) as r_squared from r"
)


# alerts --------------------------------------------------------------------------------------------------------------
def alerts_query(name: str, level: str = "low") -> tuple[Callable, str]:
    head = base_sql(name)
    pct = lambda a, b: f"round({a} * 100.0::double / {b}, 2)"
    idc = "n > 10 and up > 95"
    rules = [
        ("mp > 0", "case when mp > 50 then 'High' when mp > 10 then 'Medium' else 'Low' end", "Missing Values", "mp, '% missing.'"),
        ("fam='n' and n > 1 and coalesce(vr, 0) = 0", "'High'", "Constant Column", "'all ', n, ' values are equal'"),
        ("fam='n' and vr > 0 and abs(sk) > 1", "case when abs(sk) > 2 then 'Medium' else 'Low' end", "Skewed Distribution", "'skewness ', round(sk, 2)"),
        ("fam='n' and vr > 0 and op > 0", "case when op > 25 then 'High' when op > 10 then 'Medium' else 'Low' end", "Outliers", "op, '% lie outside the quartile fences'"),
        ("fam='n' and vr > 0 and ze * 100.0 / n > 50", "'Medium'", "Zero-Heavy Column", f"'zeros: ', {pct('ze', 'n')}, '%'"),
        (idc, "'Low'", "Possible ID Column", "up, '% distinct, as a key would be'"),
        (f"fam='s' and not ({idc}) and u > 50 and up > 50", "'Medium'", "High Cardinality", "u, ' categories, too many for one-hot columns'"),
        ("fam='s' and nn > 0 and mf * 1.0 / nn > 0.95", "'Medium'", "Near-Constant Column", f"{pct('mf', 'nn')}, '% are ''', mode, ''''"),
        ("fam='s' and nn > 0 and nl * 1.0 / nn > 0.8", "'Medium'", "Wrong Data Type", f"{pct('nl', 'nn')}, '% parse as numbers, the type is ', dtype"),
        ("fam='s' and em > 0 and round(em * 100.0 / nn, 2) > 0", "case when round(em * 100.0 / nn, 2) > 5 then 'Medium' else 'Low' end", "Empty Strings", f"'empty strings: ', {pct('em', 'nn')}, '%'"),
        ("fam='s' and sp > 0 and round(sp * 100.0 / nn, 2) > 0", "'Low'", "Extra Whitespace", f"'blanks at an end: ', {pct('sp', 'nn')}, '%'"),
    ]
    body = " union all ".join(f"select {sev} as severity, \"column\", '{a}' as alert, concat({text}) as details from st where {cond}" for cond, sev, a, text in rules)
    body += f" union all select case when confidence_pct >= 90 then 'High' else 'Medium' end, \"column\", 'Potential PII', concat(pii_type, ', confidence ', confidence_pct, '%') from ({pii_sql(name)}) p"
    dup = "select case when p > 20 then 'High' when p > 5 then 'Medium' else 'Low' end, '(table)', 'Duplicate Rows', concat(p, '% repeat another row') from (select round((count(*) - (select count(*) from (select distinct * from src))) * 100.0::double / count(*), 2) as p from src) where p > 0"
    nums = numeric(name)
    pairs = [(a, b) for i, a in enumerate(nums) for b in nums[i + 1 :]]
    cor = "".join(f" union all select case when abs(r) >= 0.95 then 'High' else 'Medium' end, '{a} & {b}', 'Highly Correlated Pair', concat('Pearson ', r) from (select {_corr(a, b)} as r from src) where abs(r) >= 0.8" for a, b in pairs)
    keep = {"low": "", "medium": " where severity <> 'Low'", "high": " where severity = 'High'"}[level]
    sql = head + f"select * from ({body} union all {dup}{cor}) a" + keep
    return (lambda spark, sf: DataProfiler(source(spark, sf, name)).alerts(min_severity=level)), sql


# relationships -------------------------------------------------------------------------------------------------------
def relation(name: str, sql: str | None = None) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return RelationshipAnalyzer(source(spark, sf_dir, name)).analyze().to_dataframe().select("column_a", "column_b", "type_a", "type_b", "method", "strength", "direction", "confidence", "classification", "sample_size", "notes")

    return run


SOURCES["statuses"] = "select o_orderstatus, o_orderpriority, o_totalprice, o_orderdate from orders"
SOURCES["eventvalue"] = "select event_type, value, ts from events"
_CLASS = "case when strength >= 0.8 then 'Strong' when strength >= 0.5 then 'Moderate' when strength >= 0.2 then 'Weak' else 'Not Meaningful' end as classification, case when sample_size >= 500 then 'High' when sample_size >= 100 then 'Medium' else 'Low' end as confidence"


def eta_sql(src: str, a: str, ta: str, b: str, tb: str) -> str:
    return f"select '{a}' as column_a, '{b}' as column_b, '{ta}' as type_a, '{tb}' as type_b, 'ANOVA (eta²)' as method, (select round(sum(n * (m - g) * (m - g)) / (sum(n * (m - g) * (m - g)) + sum(w)), 4) from (select count(x) as n, avg(x) as m, var_pop(x) * count(x) as w from (select {a} as c, {b} as x from ({src})) group by c), (select avg({b}) as g from ({src}))) as strength, 'N/A' as direction, (select count({b}) from ({src})) as sample_size, '' as notes"


def cramer_sql(src: str, a: str, ta: str, b: str, tb: str) -> str:
    t = f"(select *, sum(n) over (partition by a) as ra, sum(n) over (partition by b) as cb, sum(n) over () as t from (select {a} as a, {b} as b, count(*) as n from ({src}) group by all))"
    return (
        f"select '{a}' as column_a, '{b}' as column_b, '{ta}' as type_a, '{tb}' as type_b, 'Cramér''s V' as method, round(least(1, sqrt(greatest(0, (sum(n * n::double / (ra::double * cb)) - 1)) / (least(count(distinct a), count(distinct b)) - 1))), 4) as strength, 'N/A' as direction, cast(sum(n) as bigint) as sample_size, "
        f"concat('Normalized Mutual Info: ', printf('%.2f', least(1, greatest(0, sum(n / t::double * ln(n * t::double / (ra::double * cb))) / least((select -sum(p * ln(p)) from (select sum(n) / max(t)::double as p from {t} group by a)), (select -sum(p * ln(p)) from (select sum(n) / max(t)::double as p from {t} group by b))))))) as notes from {t}"
    )


def trend_sql(src: str, a: str, ta: str, b: str, tb: str, date_first: bool) -> str:
    d, x = (a, b) if date_first else (b, a)
    r = f"(select rank() over (order by d) + (count(*) over (partition by d) - 1) / 2.0 as p, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as q from (select cast({d} as date) as d, {x} as x from ({src})))"
    return f"select '{a}' as column_a, '{b}' as column_b, '{ta}' as type_a, '{tb}' as type_b, 'Datetime Trend (Spearman)' as method, round(abs(corr(p, q)), 4) as strength, case when corr(p, q) > 0.05 then 'Increasing' when corr(p, q) < -0.05 then 'Decreasing' else 'Flat' end as direction, count(*) as sample_size, '' as notes from {r}"


def number_sql(src: str, a: str, ta: str, b: str, tb: str) -> str:
    """The stronger of Pearson and Spearman over complete rows."""
    rank = lambda c: f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0"
    t = f"(select x, y, {rank('x')} as p, {rank('y')} as q from (select cast({a} as double) as x, cast({b} as double) as y from ({src})) where x is not null and y is not null)"
    return (
        f"select '{a}' as column_a, '{b}' as column_b, '{ta}' as type_a, '{tb}' as type_b, case when abs(u) >= abs(v) then 'Pearson' else 'Spearman' end as method, round(greatest(abs(u), abs(v)), 4) as strength, "
        f"case when (case when abs(u) >= abs(v) then u else v end) > 0 then 'Positive' else 'Negative' end as direction, n as sample_size, '' as notes from (select coalesce(corr(x, y), 0) as u, coalesce(corr(p, q), 0) as v, count(*) as n from {t})"
    )


def relation_sql(parts: list[str]) -> str:
    return f"select column_a, column_b, type_a, type_b, method, cast(strength as double) as strength, direction, sample_size, notes, {_CLASS} from (" + " union all ".join(parts) + ")"


PRICES = {"l_linenumber": "numeric", "l_quantity": "numeric", "l_extendedprice": "currency", "l_discount": "numeric", "cost": "currency", "square": "numeric"}
PRICES_SQL = relation_sql([number_sql(SOURCES["prices"], a, PRICES[a], b, PRICES[b]) for i, a in enumerate(PRICES) for b in [*PRICES][i + 1 :]])


def top_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RelationshipAnalyzer(source(spark, sf_dir, "prices")).analyze().top(5).select("column_a", "column_b", "method", "strength", "classification")


def graph_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RelationshipAnalyzer(source(spark, sf_dir, "prices")).analyze().graph(threshold=0.5).to_dataframe()


def redundant_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RelationshipAnalyzer(source(spark, sf_dir, "prices")).analyze().redundant_columns().select("group_id", F.explode("columns").alias("column"))


TOP_SQL = f"select column_a, column_b, method, strength, classification from ({PRICES_SQL}) where strength >= 0.2 order by strength desc, column_a, column_b limit 5"
GRAPH_SQL = f"select column_a, column_b, strength, classification from ({PRICES_SQL}) where strength >= 0.5 order by strength desc, column_a, column_b limit 20"
# the pairs from 0.95 on have no column in common here, so each is a group
GROUPS_SQL = f"select dense_rank() over (order by least(column_a, column_b)) - 1 as group_id, unnest([column_a, column_b]) as \"column\" from ({PRICES_SQL}) where strength >= 0.95"


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment", F.substring("c_mktsegment", 1, 1).alias("initial"))
    return RelationshipAnalyzer(df).analyze().dependencies()


_FD = [("c_custkey", "c_name"), ("c_custkey", "c_mktsegment"), ("c_custkey", "initial"), ("c_name", "c_custkey"), ("c_name", "c_mktsegment"), ("c_name", "initial"), ("c_mktsegment", "c_custkey"), ("c_mktsegment", "c_name"), ("c_mktsegment", "initial"), ("initial", "c_custkey"), ("initial", "c_name"), ("initial", "c_mktsegment")]
FD_SQL = "with src as (select c_custkey, c_name, c_mktsegment, substr(c_mktsegment, 1, 1) as initial from customer) select source, target, consistency_pct, rows_checked from (" + " union all ".join(
    f"select '{s}' as source, '{t}' as target, round(sum(case when k = 1 then n else 0 end) * 100.0::double / sum(n), 2) as consistency_pct, cast(sum(n) as bigint) as rows_checked, count(*) as g from (select {s}, count(*) as n, count(distinct {t}) as k from src group by 1)" for s, t in _FD
) + ") where g >= 2 and consistency_pct >= 95"


def semantic_query(name: str) -> Callable:
    return lambda spark, sf: table(df := source(spark, sf, name), list(semantic.semantic_types(df).items()), "column string, semantic_type string")


SEMANTIC_ORDERS_SQL = (
    "select * from (select 'o_orderkey' as \"column\", case when count(distinct o_orderkey) >= 0.95 * count(*) then 'id' else 'numeric' end as semantic_type from orders union all select 'o_custkey', case when count(distinct o_custkey) >= 0.95 * count(*) then 'id' else 'numeric' end from orders "
    "union all select 'o_orderdate', 'datetime' union all select 'o_orderstatus', 'categorical' union all select 'o_totalprice', 'currency' union all select 'o_orderpriority', 'categorical')"
)
SEMANTIC_LABELS_SQL = "select 'doc_id' as \"column\", case when count(distinct doc_id) >= 0.95 * count(*) then 'id' else 'numeric' end as semantic_type from labels union all select 'quality', case when count(distinct quality) = 1 then 'constant' else 'boolean' end from labels union all select 'toxic', case when count(distinct toxic) = 1 then 'constant' else 'boolean' end from labels"


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for name in ("flags", "labels"):
        n, twice = duplicate_rows(df := source(spark, sf_dir, name))
        rows.append((name, n, twice, share(twice, n)))
    return table(df, rows, "source string, n_rows long, duplicate_rows long, duplicate_pct double")


DUPLICATES_SQL = " union all ".join(
    f"select '{n}' as source, count(*) as n_rows, count(*) - (select count(*) from (select distinct * from ({SOURCES[n]}))) as duplicate_rows, round((count(*) - (select count(*) from (select distinct * from ({SOURCES[n]})))) * 100.0::double / count(*), 2) as duplicate_pct from ({SOURCES[n]})" for n in ("flags", "labels")
)


def redundant(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", F.col("p_size").alias("size_copy"), F.col("p_brand"), F.col("p_brand").alias("brand_copy"))
    return table(df, relate.equal_columns(df), "column_a string, column_b string")


REDUNDANT_SQL = "select 'p_size' as column_a, 'size_copy' as column_b union all select 'p_brand', 'brand_copy'"


# comparison ----------------------------------------------------------------------------------------------------------
SOURCES["before"] = "select o_orderkey, case when o_orderkey % 7 = 0 then null else o_totalprice end as o_totalprice, o_orderpriority, o_orderstatus from orders"


def compare(level: str, changes: bool = False) -> Callable:
    return lambda spark, sf: DataComparator().compare_dataframe(source(spark, sf, "before"), source(spark, sf, "after"), level, changes).select("section", "metric", *(F.round(c, 4).alias(c) for c in ("before_value", "after_value", "change")), "status")


def _cmp(section: str, metric: str, b: str, a: str, status: str, digits: int | None = 4) -> str:
    r = lambda e: f"round({e}, {digits or 4})"
    return f"select '{section}' as section, '{metric}' as metric, {r(f'cast(({b}) as double)')} as before_value, {r(f'cast(({a}) as double)')} as after_value, {status} as rule"


def compare_sql(changes: bool) -> str:
    rows = []
    for c in ("o_orderkey", "o_totalprice"):
        q = lambda e: tuple(f"select {e.format(c=c)} from {t}" for t in ("b", "a"))  # noqa: B023, E731
        rows.append(_cmp("Missing", c, *q("count(*) - count({c})"), "'Fixed'"))
        rows.append(_cmp("Zero", c, *q("count(*) filter (where {c} = 0)"), "'Improved'"))
        rows += [_cmp("Statistics", f"{c}_{n}", *q(e), "''") for n, e in (("mean", "avg({c})"), ("median", "quantile_cont(cast({c} as double), 0.5)"), ("std", "stddev_samp({c})"), ("min", "min({c})"), ("max", "max({c})"))]
        rows += [_cmp("Quantile", f"{c}_Q{int(p * 100)}", *q("quantile_cont(cast({c} as double), " + str(p) + ")"), "''", None) for p in (0.25, 0.5, 0.75, 0.95)]
        out = "(select count(*) from {t}, (select quantile_cont(cast({c} as double), 0.25) as l, quantile_cont(cast({c} as double), 0.75) as h from {t}) where {c} < l - 1.5 * (h - l) or {c} > h + 1.5 * (h - l))"
        rows.append(_cmp("Outlier", c, *("select " + out.format(c=c, t=t) for t in ("b", "a")), "'Reduced'"))
    rows.append(_cmp("Missing", "o_orderpriority", *(f"select count(*) - count(o_orderpriority) from {t}" for t in ("b", "a")), "'Fixed'"))
    rows.append(_cmp("Category", "o_orderpriority", *(f"select count(distinct o_orderpriority) from {t}" for t in ("b", "a")), "''"))
    keep = " where change <> 0" if changes else ""
    return f"with b as ({SOURCES['before']}), a as ({SOURCES['after']}) select section, metric, before_value, after_value, change, case when rule = '' then case when before_value <> after_value then 'Changed' else 'Same' end when after_value < before_value then rule else 'Same' end as status from (select *, round(after_value - before_value, 4) as change from (" + " union all ".join(rows) + "))" + keep


def compare_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DataComparator().compare_dataframe(source(spark, sf_dir, "before"), source(spark, sf_dir, "after"), "dataset").select("section", "metric", *(F.round(c, 4).alias(c) for c in ("before_value", "after_value", "change")), "status")


_CELLS = {"b": ("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus"), "a": ("o_orderkey", "o_totalprice", "o_orderpriority", "added")}
_BYTES = {"b": "count(o_orderkey) * 8 + count(o_totalprice) * 8 + sum(strlen(o_orderpriority)) + sum(strlen(o_orderstatus))", "a": "count(o_orderkey) * 8 + count(o_totalprice) * 8 + sum(strlen(o_orderpriority)) + count(added) * 4"}
_DATASET = {
    "Rows": lambda t: f"select count(*) from {t}", "Columns": lambda t: f"select {len(_CELLS[t])}", "Missing Cells": lambda t: "select " + " + ".join(f"count(*) - count({c})" for c in _CELLS[t]) + f" from {t}",
    "Duplicate Rows": lambda t: f"select (select count(*) from {t}) - (select count(*) from (select distinct * from {t}))", "Memory MB": lambda t: f"select ({_BYTES[t]}) / 1048576.0::double from {t}",
}
DATASET_SQL = f"with b as ({SOURCES['before']}), a as ({SOURCES['after']}) select section, metric, before_value, after_value, round(after_value - before_value, 4) as change, case when after_value < before_value then 'Improved' when after_value > before_value then 'Increased' else 'Same' end as status from (" + " union all ".join(_cmp("Dataset", m, f("b"), f("a"), "''") for m, f in _DATASET.items()) + ")"


def compare_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DataComparator().summary(source(spark, sf_dir, "before"), source(spark, sf_dir, "after"))


def _note(label: str, expr: str, digits: int | None = None) -> str:
    """A note where the value differs between b and a; digits: those it is compared by, and two to show it."""
    b, a = (f"(select {expr} from {t})" for t in ("b", "a"))
    show = lambda v: f"round({v}, 2)" if digits else v
    same = f"round({b}, {digits}) <> round({a}, {digits})" if digits else f"{b} <> {a}"
    return f"case when {same} then concat('{label} ', {show(b)}, '->', {show(a)}) end"


def _summary_sql() -> str:
    rows = ["select 'o_orderstatus' as \"column\", 'Removed' as status, 'Column removed' as summary", "select 'added', 'Added', 'Column added'"]
    for c in ("o_orderkey", "o_totalprice", "o_orderpriority"):
        x = f"cast({c} as double)"
        notes = [_note("missing", f"count(*) - count({c})")]
        if c == "o_orderpriority":
            notes.append(_note("unique", f"count(distinct {c})"))
        else:
            fence = "(select count(*) from {t}, (select quantile_cont({x}, 0.25) as l, quantile_cont({x}, 0.75) as h from {t}) where {c} < l - 1.5 * (h - l) or {c} > h + 1.5 * (h - l))"
            b, a = (fence.format(t=t, x=x, c=c) for t in ("b", "a"))
            notes += [f"case when {b} <> {a} then concat('outliers ', {b}, '->', {a}) end", _note("mean", f"avg({x})", 4)]
        rows.append(f"select '{c}', case when t = '' then 'Unchanged' else 'Changed' end, case when t = '' then 'No change' else t end from (select concat_ws('; ', {', '.join(notes)}) as t)")
    return f"with b as ({SOURCES['before']}), a as ({SOURCES['after']}) " + " union all ".join(rows)


SUMMARY_SQL = _summary_sql()


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    out = windowed_quality(ev, "ts", "1 day", by=["event_type"])
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n_rows", "value_missing", F.round("value_mean", 4).alias("value_mean"), "value_min", "value_max")


WINDOWS_SQL = "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n_rows, count(*) - count(value) as value_missing, round(avg(value), 4) as value_mean, min(value) as value_min, max(value) as value_max from events group by 1, 2"


def _build() -> tuple[dict[str, Callable], dict[str, str]]:
    q: dict[str, tuple[Callable, str | None]] = {}
    for section, names in {
        "schema": ("lineitem", "customer", "holes", "events", "documents", "orders"), "statistics": ("lineitem", "orders", "events", "part", "holes"), "quality": ("lineitem", "holes", "documents"),
        "ml": ("lineitem", "customer", "labels", "documents"), "etl": ("documents", "supplier", "talks", "holes"),
    }.items():
        for n in names:
            q[f"{section}_{n}"] = section_query(n, section)
    q["quality_score_holes"] = score_query("holes", None, "overall")
    q["quality_score_by_column_customer"] = score_query("customer", None, "column")
    q["quality_score_by_column_holes"] = score_query("holes", None, "column")
    q["quality_score_weighted_lineitem"] = score_query("lineitem", {"outliers": 50, "missing": 10}, "overall")
    for n in ("customer", "part", "talks", "supplier", "contacts"):
        q[f"pii_{n}"] = pii_query(n)
    q["pii_any_orders"] = pii_query("orders", 0)
    q["pii_any_documents"] = pii_query("documents", 0)
    q["mask_contacts"] = (mask_table, MASK_TABLE_SQL)
    q["mask_values"] = (mask_values, MASK_SQL)
    q["corr_pairs_lineitem"] = corr_query("lineitem")
    q["corr_matrix_part"] = corr_query("part", by="matrix")
    q["corr_matrix_derived"] = corr_query("derived", by="matrix")
    q["corr_threshold_derived"] = corr_query("derived", threshold=0.5)
    q["corr_spearman_part"] = corr_query("part", "spearman")
    q["corr_spearman_events"] = corr_query("events", "spearman")
    q["corr_kendall_part"] = (kendall, KENDALL_SQL)
    for n in ("lineitem", "labels", "holes", "events", "documents"):
        q[f"alerts_{n}"] = alerts_query(n)
    q["alerts_high_holes"] = alerts_query("holes", "high")
    q["alerts_high_contacts"] = alerts_query("contacts", "high")
    q["alerts_pii_part"] = alerts_query("part")
    q["alerts_contacts"] = alerts_query("contacts")
    q["semantic_types_orders"] = (semantic_query("orders"), SEMANTIC_ORDERS_SQL)
    q["semantic_types_labels"] = (semantic_query("labels"), SEMANTIC_LABELS_SQL)
    s, e = SOURCES["statuses"], SOURCES["eventvalue"]
    q["relationships_orders"] = (relation("statuses"), relation_sql([cramer_sql(s, "o_orderstatus", "categorical", "o_orderpriority", "categorical"), eta_sql(s, "o_orderstatus", "categorical", "o_totalprice", "currency"), eta_sql(s, "o_orderpriority", "categorical", "o_totalprice", "currency"), trend_sql(s, "o_totalprice", "currency", "o_orderdate", "datetime", False)]))
    q["relationships_events"] = (relation("eventvalue"), relation_sql([eta_sql(e, "event_type", "categorical", "value", "currency"), trend_sql(e, "value", "currency", "ts", "datetime", False)]))
    q["relationships_prices"] = (relation("prices"), PRICES_SQL)
    q["relationships_top_prices"] = (top_prices, TOP_SQL)
    q["relationships_graph_prices"] = (graph_prices, GRAPH_SQL)
    q["redundant_groups_prices"] = (redundant_prices, GROUPS_SQL)
    q["cramers_v_flags"] = (relation("flags"), relation_sql([cramer_sql(SOURCES["flags"], "l_returnflag", "categorical", "l_linestatus", "categorical")]))
    q["functional_dependencies_customer"] = (dependencies, FD_SQL)
    q["redundant_columns_part"] = (redundant, REDUNDANT_SQL)
    q["duplicate_rows"] = (duplicates, DUPLICATES_SQL)
    q["compare_orders"] = (compare("ml"), compare_sql(False))
    q["compare_orders_changes_only"] = (compare("ml", True), compare_sql(True))
    q["compare_schema_orders"] = (lambda sp, sf: compare("schema")(sp, sf).select("section", "metric", "status"), "select 'Schema' as section, 'added' as metric, 'New Column' as status union all select 'Schema', 'o_orderstatus', 'Deleted Column'")
    q["compare_dataset_orders"] = (compare_dataset, DATASET_SQL)
    q["compare_summary_orders"] = (compare_summary, SUMMARY_SQL)
    q["windowed_quality_events"] = (windows, WINDOWS_SQL)
    return {k: v[0] for k, v in q.items()}, {k: v[1] for k, v in q.items() if v[1]}


QUERIES, SQL = _build()
