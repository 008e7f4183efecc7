"""The queries over the driver's tables, each with the same in DuckDB's SQL where SQL can express it.

Splits are tagged by rules that both engines share: T1, orders by date; T2, any table by key modulo 10.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalguard.functions import canon
from evalguard.operators import distribution, duplicates, frames, labels, leakage, resplit, structural, versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

T1 = "case when o_orderdate < timestamp '2000-01-01' then 'train' when o_orderdate < timestamp '2000-10-01' then 'val' else 'test' end"


def t2(key: str) -> str:
    return f"case when {key} % 10 < 7 then 'train' when {key} % 10 = 7 then 'val' else 'test' end"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("split", F.expr(T1.replace("timestamp '", "timestamp_ntz '")))


def tagged(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return table(spark, sf_dir, name).withColumn("split", F.expr(t2(key)))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir, "documents", "doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")


def r6(c: Column | str) -> Column:
    """Rounded for comparison; zero has no sign."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


LABELLED = f"select d.*, l.quality, l.toxic, {t2('d.doc_id')} as split from documents d left join labels l using (doc_id)"
ORDERS = f"select *, {T1} as split from orders"
LINES = f"select *, {t2('l_orderkey')} as split from lineitem"


# ---- identity and splits


@query(f"""with t as ({LABELLED}), u as (select split, coalesce(cast(quality as varchar), '<unlabeled>') as label from t)
select split, null as label, count(*) as n from u group by split union all select null, label, count(*) from u group by label""")
def identity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structural.identity_counts(labelled(spark, sf_dir), "split", "quality")


@query(f"""with t as ({ORDERS}), d as (select * from (values ('train', 'train'), ('val', 'val'), ('test', 'test'), ('holdout', 'unknown')) v(split, role))
select d.split, d.role, count(t.split) as n from d left join t on d.split = t.split group by all""")
def dd002_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structural.split_sizes(orders(spark, sf_dir), "split", ["train", "val", "test", "holdout"])


# ---- duplicates

_GROUPS = f"with t as (select *, {t2('doc_id')} as split from documents), g as (select sha256(text) as digest, count(*) as n, list_sort(list(distinct split)) as splits from t group by text having count(*) > 1)"


def _document_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tagged(spark, sf_dir, "documents", "doc_id").select("split", F.sha2("text", 256).alias("digest"))
    return duplicates.digest_groups(docs, "digest", "split")


@query(_GROUPS + """, p as (select n, unnest(splits) as split_a, splits from g where len(splits) > 1), q as (select n, split_a, unnest(splits) as split_b from p)
select split_a, split_b, count(*) as n_groups, cast(sum(n) as bigint) as affected, cast(sum(n - 1) as bigint) as redundant from q where split_a < split_b group by all""")
def dd003_cross_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.cross_split(_document_groups(spark, sf_dir))


@query(_GROUPS + """ select splits[1] as split, count(*) as n_groups, cast(sum(n) as bigint) as affected, cast(sum(n - 1) as bigint) as redundant from g where len(splits) = 1 group by 1""")
def dd003_within_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.within_split(_document_groups(spark, sf_dir))


@query("select min(doc_id) as doc_id, length(text) as chars from documents group by text")
def exact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("digest"))
    return duplicates.first_rows(docs, F.col("digest"), "doc_id").select("doc_id", "chars")


def sign_hash_sql(bits: int = 64) -> str:
    parts = [f"(case when embedding[{i + 1}] > 0 then {1 << i if i < 63 else '-9223372036854775808'} else 0 end)" for i in range(bits)]
    return " + ".join(f"cast({p} as hugeint)" for p in parts)


@query(f"""with h as (select vec_id, cast({sign_hash_sql()} as bigint) as h from embeddings)
select a.vec_id as a, b.vec_id as b, cast(bit_count(xor(a.h, b.h)) as integer) as distance from h a join h b on a.vec_id < b.vec_id and a.h <> b.h and bit_count(xor(a.h, b.h)) <= 16""")
def dd004_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near pairs of rows; a missing vector has no sign, as in the SQL."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id is not null").select("vec_id", F.coalesce(duplicates.sign_hash(F.col("embedding")), F.lit(0).cast("long")).alias("h"))
    return duplicates.near_pairs(rows, "vec_id", "h", 16)


@query(f"""with h as (select vec_id, embedding, cast({sign_hash_sql()} as bigint) as h from embeddings where embedding is not null),
g as (select h, min(vec_id) as class_id, count(*) as class_size, count(distinct embedding) as n_contents from h group by h having count(distinct embedding) > 1)
select h.vec_id, g.class_id, g.class_size, g.n_contents from h join g on h.h = g.h""")
def dd004_equal_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", duplicates.sign_hash(F.col("embedding")).alias("h"))
    return duplicates.equal_hash_classes(rows, "vec_id", "h", "embedding")


# ---- leakage

_ENTITIES = f"with t as ({ORDERS}), e as (select o_custkey, split, count(*) as n from t group by all)"


@query(_ENTITIES + """ select a.split as split_a, b.split as split_b, count(*) as n_entities, cast(sum(a.n + b.n) as bigint) as affected_rows
from e a join e b on a.o_custkey = b.o_custkey and a.split < b.split group by all""")
def dd005_entity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.entity_pairs(orders(spark, sf_dir), "o_custkey", "split")


@query(f"""with t as ({ORDERS}) select split, count(*) as rows, count(*) filter (o_custkey is null) as missing, count(distinct o_custkey) as distinct_entities,
round(count(*) filter (o_custkey is null) / count(*), 6) as missing_ratio from t group by split""")
def dd005_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.entity_coverage(orders(spark, sf_dir), "o_custkey", "split").withColumn("missing_ratio", r6("missing_ratio"))


@query(_ENTITIES + """ select cast(o_custkey as varchar) as entity, cast(sum(n) as bigint) as n, array_to_string(list_sort(list(distinct split)), ',') as splits
from e group by 1 having count(*) > 1 order by n desc, entity limit 20""")
def dd005_largest_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.largest_entities(orders(spark, sf_dir), "o_custkey", "split").withColumn("splits", F.concat_ws(",", "splits"))


@query(f"""with t as (select o_orderdate, {t2('o_orderkey')} as split from orders), b as (select min(o_orderdate) filter (split = 'test') as test_min from t)
select max(o_orderdate) filter (split = 'train') as train_max, any_value(test_min) as test_min, count(*) filter (split = 'train') as n_train, count(*) filter (split = 'test') as n_test,
count(*) filter (split = 'train' and o_orderdate >= test_min) as violating from t, b""")
def dd006_temporal_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.temporal_boundary(tagged(spark, sf_dir, "orders", "o_orderkey"), F.col("o_orderdate"), "split", "train", "test")


_FEATURES = ("o_orderpriority", "status_copy", "status_code")


def _with_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    return table(spark, sf_dir, "orders").withColumn("status_copy", F.col("o_orderstatus")).withColumn("status_code", code)


_PAIRS = """with t as (select o_orderstatus as y, o_orderpriority, o_orderstatus as status_copy, cast(case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end as varchar) as status_code from orders),
l as (select 'o_orderpriority' as "column", o_orderpriority as x, y from t union all select 'status_copy', status_copy, y from t union all select 'status_code', status_code, y from t)"""


@query(_PAIRS + """, p as (select "column", x, y from l group by all),
f as (select "column", max(k) as max_y_per_f, count(*) as n_f from (select "column", x, count(*) as k from p group by all) group by 1),
g as (select "column", max(k) as max_f_per_y, count(*) as n_y from (select "column", y, count(*) as k from p group by all) group by 1)
select f."column", max_y_per_f, n_f, max_f_per_y, n_y, (select bool_and(x = y) from p where p."column" = f."column") as identical from f join g using ("column")""")
def dd007_functional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.functional(_with_leaks(spark, sf_dir), _FEATURES, "o_orderstatus")


@query("""with l as (select 'l_quantity' as "column", l_quantity as x, l_linestatus = 'O' as p from lineitem union all select 'l_discount', l_discount, l_linestatus = 'O' from lineitem
union all select 'l_extendedprice', l_extendedprice, l_linestatus = 'O' from lineitem),
r as (select "column", p, rank() over (partition by "column" order by x) + (count(*) over (partition by "column", x) - 1) / 2.0 as k from l),
s as (select "column", count(*) as n, count(*) filter (p) as n_pos, sum(k) filter (p) as ranks from r group by 1)
select "column", n, n_pos, round((ranks - n_pos * (n_pos + 1) / 2.0) / (cast(n_pos as double) * (n - n_pos)), 6) as auc from s""")
def dd007_rank_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = leakage.feature_auc(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"], F.col("l_linestatus") == "O")
    return out.withColumn("auc", r6("auc"))


@query(_PAIRS + """, c as (select "column", x, y, cast(count(*) as double) as n from l group by all),
w as (select *, sum(n) over (partition by "column", x) as nx, sum(n) over (partition by "column", y) as ny, sum(n) over (partition by "column") as a from c),
s as (select "column", sum(n / a * ln(n * a / (nx * ny))) as mi, -sum(n / a * ln(ny / a)) as h from w group by 1) select "column", round(mi / h, 6) + 0.0 as nmi from s""")
def dd007_nmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.feature_nmi(_with_leaks(spark, sf_dir), _FEATURES, "o_orderstatus").withColumn("nmi", r6("nmi"))


@query(f"""with t as ({ORDERS}), l as (select split, 'o_orderkey' as "column", cast(o_orderkey as varchar) as x from t union all select split, 'o_custkey', cast(o_custkey as varchar) from t
union all select split, 'o_orderpriority', o_orderpriority from t), n as (select split, count(*) as n_rows from t group by 1)
select split, "column", any_value(n_rows) as n_rows, count(distinct x) as n_unique, round(count(distinct x) / any_value(n_rows), 6) as ratio from l join n using (split) group by all""")
def dd008_unique_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.unique_ratio(orders(spark, sf_dir), ["o_orderkey", "o_custkey", "o_orderpriority"], "split").withColumn("ratio", r6("ratio"))


@query(f"""with t as ({ORDERS}), l as (select split, 'o_orderkey' as c, cast(o_orderkey as varchar) as x from t union all select split, 'o_orderpriority', o_orderpriority from t)
select split, c as "column", count(x) as filled, min(length(x)) as min_length, max(length(x)) as max_length, round(avg(cast(regexp_full_match(x, '[0-9]+') as integer)), 6) as digits from l group by all""")
def value_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.value_shape(orders(spark, sf_dir), ["o_orderkey", "o_orderpriority"], "split").withColumn("digits", r6("digits"))


# ---- labels


@query(f"""with t as ({LABELLED}), g as (select text, count(*) as n, list_sort(list(distinct split)) as splits from t group by text having count(distinct coalesce(cast(quality as varchar), '<unlabeled>')) > 1)
select case when len(splits) > 1 then 'cross' else splits[1] end as scope, count(*) as n_groups, cast(sum(n) as bigint) as affected, 0 as encoding_only from g group by 1""")
def dd009_label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).select("split", "quality", F.sha2("text", 256).alias("digest"))
    return labels.conflict_summary(labels.conflicts(rows, "digest", "quality", "split"))


@query(f"with t as ({LABELLED}) select split, count(*) as rows, count(*) filter (quality is null) as unlabelled, round(count(*) filter (quality is null) / count(*), 6) as ratio from t group by 1")
def dd010_missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.missing(labelled(spark, sf_dir), "quality", "split").withColumn("ratio", r6("ratio"))


@query(f"""with t as ({LABELLED}), c as (select toxic, count(*) as n from t where toxic is not null group by 1), s as (select *, n / sum(n) over () as p from c)
select count(*) as n_classes, cast(sum(n) as bigint) as rows, round(max(n) / min(n), 6) as imbalance_ratio, round(min(n) / sum(n), 6) as minority_share, round(-sum(p * log2(p)), 6) as entropy,
round(pow(2.0, -sum(p * log2(p))), 6) as effective_classes from s""")
def dd011_class_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = labels.imbalance(labelled(spark, sf_dir), "toxic")
    return out.select("n_classes", "rows", *(r6(c).alias(c) for c in ("imbalance_ratio", "minority_share", "entropy", "effective_classes")))


_SHARES = """, k as (select * from (select distinct split from c where split <> 'train') cross join (select distinct label from c)),
j as (select k.split, k.label, coalesce(a.n, 0) as t, coalesce(b.n, 0) as r from k left join c a using (split, label) left join (select * from c where split = 'train') b on b.label = k.label),
s as (select *, t / sum(t) over (partition by split) as q, r / sum(r) over (partition by split) as p from j)
select split, round(sum(abs(p - q)) / 2, 6) as tv, round(sqrt(greatest(0, sum(case when p > 0 then p * ln(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * ln(q / ((p + q) / 2)) else 0 end) / 2)), 6) as js,
count(*) filter (t > 0 and r > 0) as common_classes from s group by split"""


@query(f"with t as ({LABELLED}), c as (select split, cast(quality as varchar) as label, count(*) as n from t where quality is not null group by all)" + _SHARES)
def dd013_label_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.shift(labelled(spark, sf_dir), "quality", "split", "train").withColumn("tv", r6("tv")).withColumn("js", r6("js"))


# ---- distributions


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem by order key, with a planted shift of the quantity in the test split."""
    lines = tagged(spark, sf_dir, "lineitem", "l_orderkey")
    return lines.withColumn("planted", F.when(F.col("split") == "test", F.col("l_quantity") * 1.5 + 10).otherwise(F.col("l_quantity")))


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "planted")
_VALUES = f"""with t as (select *, case when split = 'test' then l_quantity * 1.5 + 10 else l_quantity end as planted from ({LINES}) where split in ('train', 'test')),
v as ({" union all ".join(f"select '{c}' as k, split = 'train' as ref, cast({c} as double) as x from t" for c in _NUMBERS)})"""


@query(_VALUES + """, m as (select k, count(*) filter (ref) as n_ref, count(*) filter (not ref) as n_tgt, avg(x) filter (ref) as a, avg(x) filter (not ref) as b, var_samp(x) filter (ref) as va, var_samp(x) filter (not ref) as vb from v group by k),
c as (select k, x, count(*) filter (ref) as r, count(*) filter (not ref) as t from v group by all),
e as (select k, x, abs(sum(r) over o / sum(r) over (partition by k) - sum(t) over o / sum(t) over (partition by k)) as gap, lead(x) over (partition by k order by x) - x as step from c
  window o as (partition by k order by x rows between unbounded preceding and current row)),
d as (select k, max(gap) as ks, sum(gap * coalesce(step, 0)) as w from e group by k),
q as (select k, quantile_cont(x, 0.95) - quantile_cont(x, 0.05) as scale from v group by k),
g as (select k, list_sort(list_distinct(quantile_cont(x, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) as edges from v where ref group by k),
b as (select v.k, ref, least(len(list_filter(edges, lambda z: z <= x)) - 1, len(edges) - 2) as i from v join g using (k) where x between edges[1] and edges[-1]),
n as (select k, i, count(*) filter (ref) as r, count(*) filter (not ref) as t from b group by all),
s as (select k, greatest(r / sum(r) over (partition by k), 1e-12) as p, greatest(t / sum(t) over (partition by k), 1e-12) as q from n),
psi as (select k, sum((q - p) * ln(q / p)) as psi from s group by k)
select k as "column", n_ref, n_tgt, round((b - a) / sqrt(((n_ref - 1) * va + (n_tgt - 1) * vb) / (n_ref + n_tgt - 2)), 6) + 0.0 as smd, round(psi, 6) as psi, round(ks, 6) as ks, round(w, 6) as wasserstein,
round(w / scale, 6) as normalised_wasserstein from m join d using (k) join q using (k) join psi using (k)""")
def dd012_numeric_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = distribution.numeric_shift(_shifted(spark, sf_dir), _NUMBERS, "split", "train", "test")
    return out.select("column", "n_ref", "n_tgt", *(r6(c).alias(c) for c in ("smd", "psi", "ks", "wasserstein", "normalised_wasserstein")))


_LEVELS = ("l_returnflag", "l_linestatus", "l_linenumber")


@query(f"""with t as ({LINES}), v as ({" union all ".join(f"select '{c}' as k, split = 'train' as ref, cast({c} as varchar) as x from t where split in ('train', 'test')" for c in _LEVELS)}),
c as (select k, x, count(*) filter (ref) as r, count(*) filter (not ref) as t from v group by all), s as (select *, r / sum(r) over (partition by k) as p, t / sum(t) over (partition by k) as q from c)
select k as "column", count(*) as levels, round(sum(abs(p - q)) / 2, 6) as tv, round(sqrt(greatest(0, sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2)), 6) as js from s group by k""")
def dd012_categorical_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = distribution.categorical_shift(tagged(spark, sf_dir, "lineitem", "l_orderkey"), _LEVELS, "split", "train", "test")
    return out.select("column", "levels", r6("tv").alias("tv"), r6("js").alias("js"))


@query(f"""with t as ({LABELLED}), l as (select split, 'quality' as c, quality is null as m from t union all select split, 'text', text is null from t
union all select split, 'planted', case when split = 'test' then true else false end from t), r as (select split, c, avg(cast(m as integer)) as rate from l group by all)
select a.split, a.c as "column", round(b.rate, 6) as ref_rate, round(a.rate, 6) as rate, round(a.rate - b.rate, 6) as delta from r a join r b on a.c = b.c and b.split = 'train'
where a.split <> 'train' and abs(a.rate - b.rate) >= 0.1 - 1e-12""")
def dd015_missingness_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).withColumn("planted", F.when(F.col("split") != "test", F.lit(1)))
    return distribution.missingness_shift(rows, ["quality", "text", "planted"], "split", "train").select("split", "column", *(r6(c).alias(c) for c in ("ref_rate", "rate", "delta")))


# ---- schema, integrity, privacy


@query("""select * from (values ('train', 'c_acctbal', 'type', 'string', 'float'), ('train', 'c_extra', 'extra', null, 'int'), ('train', 'c_name', 'missing', 'string', null)) v(split, "column", problem, expected, found)""")
def dd014_schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    test = c.withColumn("c_acctbal", F.col("c_acctbal").cast("string"))
    return structural.schema_drift(spark, {"test": test, "train": c.drop("c_name").withColumn("c_extra", F.lit(1))})


@query(f"""with t as (select *, {t2('doc_id')} as split from documents), l as (select split, 'source' as c, source as x from t union all select split, 'words', cast(n_chars // 500 as varchar) from t),
k as (select distinct c, x from l where split = 'train') select split, c as "column", count(distinct x) as n_levels, count(*) as n_rows from l where split <> 'train' and (c, x) not in (select (c, x) from k) group by all""")
def dd014_unseen_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tagged(spark, sf_dir, "documents", "doc_id").withColumn("words", F.expr("n_chars div 500"))
    return structural.unseen_levels(docs, ["source", "words"], "split", "train")


@query(f"""with t as (select {t2('page_id')} as split, not contains(html, '</html>') as corrupt from pages)
select split, count(*) as files, count(*) filter (corrupt) as corrupt, 0 as uninspected, round(count(*) filter (corrupt) / count(*), 6) as rate from t group by 1""")
def dd016_corrupt_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tagged(spark, sf_dir, "pages", "page_id").select("split", (~F.contains("html", F.lit("</html>"))).alias("corrupt"), F.lit(True).alias("inspected"))
    return structural.corrupt_rates(pages, "split").withColumn("rate", r6("rate"))


@query(f"""with t as (select {t2('doc_id')} as split, nullif(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]+'), '') as mail, cast(1000000000 + doc_id * 7919 as varchar) as number from documents),
l as (select split, 'mail' as c, mail as x from t union all select split, 'number', number from t),
p as (select * from (values ('email', '^[^@ ]{{1,64}}@[^@ ]{{2,}}[.]'), ('phone_like', '^[+]?[0-9][0-9 ().-]{{7,14}}$'), ('national_id_like', '^[0-9]{{6}}[-+]?[0-9]{{4}}$|^[0-9]{{9,11}}$')) v(pattern, r))
select split, c as "column", pattern, count(*) filter (regexp_matches(x, r)) as matches, count(x) as cells, case when count(x) = 0 then 0.0 else round(count(*) filter (regexp_matches(x, r)) / count(x), 6) end as ratio
from l cross join p group by all""")
def dd021_pii_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = F.nullif(F.regexp_extract("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]+", 0), F.lit(""))
    docs = tagged(spark, sf_dir, "documents", "doc_id").withColumn("mail", mail).withColumn("number", F.lit(1000000000) + F.col("doc_id") * 7919)
    return structural.pii_rates(docs, ["mail", "number"], "split").withColumn("ratio", r6("ratio"))


# ---- versions and fingerprints


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders, and a later version: some dropped, added, moved to test, relabelled, edited."""
    old = orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "split")
    key = F.col("o_orderkey")
    new = old.where(key % 50 != 1)
    new = new.withColumn("split", F.when(key % 50 == 2, "test").otherwise(F.col("split"))).withColumn("o_orderstatus", F.when(key % 50 == 3, "X").otherwise(F.col("o_orderstatus")))
    new = new.withColumn("o_totalprice", F.when(key % 50 == 4, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    extra = old.where(key % 50 == 5).withColumn("o_orderkey", key + 1_000_000_000)
    snap = lambda d: versions.snapshot(d, ["o_orderkey"], "split", "o_orderstatus")
    return snap(old).persist(), snap(new.unionByName(extra)).persist()  # each is read several times


@query(f"""with t as ({ORDERS}) select 'removed' as kind, count(*) as n, 0 as into_test from t where o_orderkey % 50 = 1 union all
select 'added', count(*), count(*) filter (split = 'test') from t where o_orderkey % 50 = 5 union all
select 'moved', count(*), count(*) from t where o_orderkey % 50 = 2 and split <> 'test' union all
select 'relabelled', count(*), count(*) filter (split = 'test') from t where o_orderkey % 50 = 3 union all
select 'modified', count(*), count(*) filter (split = 'test') from t where o_orderkey % 50 = 4""")
def dd018_version_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.summary(versions.compare(*_versions(spark, sf_dir)))


@query(f"""with t as ({ORDERS}) select split as split_a, 'test' as split_b, 'content' as matched_by, count(*) as n from t where o_orderkey % 50 = 2 and split <> 'test' group by all""")
def dd019_split_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = versions.compare(*_versions(spark, sf_dir)).where("kind = 'moved'")
    return moved.groupBy("split_a", "split_b", "matched_by").agg(F.count("*").alias("n"))


@query(f"select o_orderkey from orders where cast('0x' || substr(sha256('1337' || chr(31) || o_orderkey), 1, 8) as bigint) < {int(0.1 * 2**32)}")
def fingerprint_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    return rows.where(canon.sampled(1337, F.col("o_orderkey").cast("string"), 0.1))


@query("select sha256(c_custkey || chr(31) || coalesce(c_name, chr(0)) || chr(31) || coalesce(c_mktsegment, chr(0))) as digest, c_custkey from customer")
def fingerprint_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(canon.digest(c, ["c_custkey", "c_name", "c_mktsegment"]).alias("digest"), "c_custkey")


@query(f"""with t as ({ORDERS}), s as (select *, cast('0x' || substr(sha256('7' || chr(31) || o_orderkey), 1, 8) as bigint) < {int(0.25 * 2**32)} as hashed from t)
select o_orderkey as id, split, case split when 'train' then 'train' when 'val' then 'val' else 'test' end as role, o_orderstatus as label, hashed as hash_sampled,
case when hashed then sha256(o_orderkey || chr(31) || o_orderstatus) end as content from s""")
def fingerprint_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", "split")
    m = versions.manifest(rows, ["o_orderkey"], "split", "o_orderstatus", mode="sampled", fraction=0.25, seed=7, sample=F.col("o_orderkey").cast("string"))
    return m.join(rows.select(F.col("o_orderkey").alias("id"), versions.id_of(rows, ["o_orderkey"], "split").alias("sample_id")), "sample_id").select("id", "split", "role", "label", "hash_sampled", "content")


# ---- splitting

_RATIOS = {"train": 0.7, "val": 0.1, "test": 0.2}


@query()
def resplit_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return resplit.split_rows(rows, _RATIOS, "o_orderkey", "o_custkey", "o_orderstatus").select("o_orderkey", "o_custkey", "split")


def _cycle_sql(period: int = 1000) -> str:
    return ", ".join(f"({i}, '{s}')" for i, s in enumerate(resplit.cycle(_RATIOS, period)))


@query(f"""with c as (select * from (values {_cycle_sql()}) v(k, split)), r as (
  select doc_id, (row_number() over (partition by lang order by sha256('1337|' || lang || '|' || doc_id), cast(doc_id as varchar)) - 1) % 1000 as k from documents)
select cast(doc_id as varchar) as unit, split from r join c using (k)""")
def resplit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("unit"), F.lit(1).alias("weight"), F.col("lang").alias("stratum"))
    return resplit.assign_rows(docs, resplit.normalise(_RATIOS), 1337)


# ---- the whole audit


@query(_ENTITIES + """, p as (select least(a.split, b.split) as x, greatest(a.split, b.split) as y, cast(sum(a.n + b.n) as bigint) as n from e a join e b on a.o_custkey = b.o_custkey and a.split < b.split group by all),
u as (select split, count(*) as n, count(distinct o_totalprice) / count(*) as ratio from t group by 1),
h as (select split, count(*) filter (regexp_full_match(cast(o_totalprice as varchar), '\\+?[0-9][0-9\\s().-]{7,14}')) as n, count(*) as rows from t group by 1)
select 'DD001' as rule_id, 'INFO' as severity, 'PASS' as status, 'NONE' as formal_impact, count(*) as affected_count, null as source_split, null as target_split from t union all
select 'DD005', case when x = 'test' and y = 'train' then 'CRITICAL' else 'HIGH' end, 'FAIL', 'BLOCKING', n, x, y from p union all
select 'DD008', 'LOW', 'WARNING', 'POTENTIAL', n, split, null from u where split = (select min(split) from u where ratio >= 0.98) union all
select 'DD020', 'LOW', 'WARNING', 'NONE', 0, null, null union all
select 'DD021', 'MEDIUM', 'WARNING', 'NONE', n, split, null from h where split = (select min(split) from h where n / rows >= 0.05)""")
def audit_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole audit: all rules over the orders, with every finding's weight and scope."""
    from evalguard.plans.engine import AuditSpec, audit

    rows = orders(spark, sf_dir).drop("o_orderkey")
    found = audit(spark, AuditSpec.of(rows, "split", label="o_orderstatus", groups=["o_custkey"], temporal="o_orderdate")).findings_frame(spark)
    return found.select("rule_id", "severity", "status", "formal_impact", "affected_count", "source_split", "target_split")


@query(f"""with t as ({LABELLED}), d as (select text, lang, source, quality from t group by all having count(distinct split) > 1),
c as (select text, lang, source from t group by all having count(distinct coalesce(cast(quality as varchar), '<unlabeled>')) > 1 and (count(distinct split) > 1 or min(split) <> 'train'))
select (select count(*) from d) + (select count(*) from c) > 0 as invalid, (select count(*) from d) + (select count(*) from c) > 0 as blocked""")
def audit_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the documents' splits make an evaluation invalid, and whether a finding blocks it."""
    from evalguard.plans import policy
    from evalguard.plans.engine import AuditSpec, audit

    docs = labelled(spark, sf_dir).select("text", "lang", "source", "quality", "split")
    report = audit(spark, AuditSpec.of(docs, "split", label="quality"))
    return spark.createDataFrame([(report.verdict == policy.INVALID, any(f["formal_impact"] == "BLOCKING" for f in report.findings))], "invalid boolean, blocked boolean")


from evalguard.plans import more_queries as _more  # noqa: E402, F401  registers its queries here
