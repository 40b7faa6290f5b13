"""Inputs shared by the registered queries, and their SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from columnwright.functions.hashing import MISSING
from columnwright.operators.bayes import BINS, UNIT
from columnwright.operators.selection import NOISE_SEED, PERMUTE_SEED
from columnwright.storage import store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------- labelled documents

QUALITY_KEYS = ["doc_id"]
QUALITY_NUMBERS = ["n_chars", "letter_share", "unique_share"]
QUALITY_CATEGORIES = ["lang", "source"]
QUALITY_FEATURES = QUALITY_NUMBERS + QUALITY_CATEGORIES


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with two text ratios, worked out before the join: no text moves."""
    words = F.split("text", " ")
    documents = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "n_chars",
        F.try_divide(
            F.length(F.regexp_replace("text", r"[^\p{L}]", "")).cast("double"), F.length("text")
        ).alias("letter_share"),
        (F.size(F.array_distinct(words)) / F.size(words).cast("double")).alias("unique_share"),
    )
    return table(spark, sf_dir, "labels").select("doc_id", "quality").join(documents, "doc_id")


def stored_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written once: scoring reads it several times."""
    return store(quality(spark, sf_dir), "quality").df


QUALITY_SQL = r"""
SELECT doc_id, quality, n_chars, lang, source,
       length(regexp_replace(text, '[^\p{L}]', '', 'g'))::DOUBLE / nullif(length(text), 0) AS letter_share,
       len(list_distinct(string_split(text, ' ')))::DOUBLE / len(string_split(text, ' ')) AS unique_share
FROM labels JOIN documents USING (doc_id)
"""

# ------------------------------------------------------------- order lines

LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents"]
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_CATEGORIES = ["l_linestatus"]
LINE_FEATURES = LINE_NUMBERS + LINE_CATEGORIES


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with a whole-number key part for the price, and a 0/1 label."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        *LINE_FEATURES,
        (F.col("l_returnflag") == "R").cast("int").alias("returned"),
    )


LINES_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
       l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus,
       CAST(l_returnflag = 'R' AS INTEGER) AS returned
FROM lineitem
"""

# ------------------------------------------------------------- SQL pieces


def key_sql(keys: Sequence[str]) -> str:
    """The key values, each with its length before it; a missing one is marked."""
    text = lambda k: f"CAST({k} AS VARCHAR)"
    parts = [f"coalesce(length({text(k)}) || ':' || {text(k)}, '{MISSING}')" for k in keys]
    return f"concat_ws('|', {', '.join(parts)})"


def hash_sql(keys: Sequence[str], *salt: object) -> str:
    return f"md5(concat_ws('|', {', '.join([key_sql(keys), *[repr(str(s)) for s in salt]])}))"


def index_sql(keys: Sequence[str], seed: object, by: str | None = None) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"row_number() OVER ({part}ORDER BY {hash_sql(keys, seed)}, {', '.join(keys)}) - 1"


def fold_sql(k: int, idx: str = "idx", n: str = "n") -> str:
    """Fold of a position when the first ``n % k`` folds get one row more."""
    return (
        f"CAST(CASE WHEN {idx} < ({n} % {k}) * ({n} // {k} + 1) THEN {idx} // ({n} // {k} + 1) "
        f"ELSE ({idx} - {n} % {k}) // ({n} // {k}) END AS INTEGER)"
    )


def kfold_rows_sql(source: str, keys: Sequence[str], k: int, seed: object = 42) -> str:
    return (
        f"SELECT * EXCLUDE (idx, n), {fold_sql(k)} AS fold FROM (SELECT *, {index_sql(keys, seed)} AS idx, "
        f"count(*) OVER () AS n FROM ({source}))"
    )


def stratified_split_sql(
    source: str, keys: Sequence[str], label: str, test_size: float = 0.2, seed: object = 42
) -> str:
    """Rows with ``is_test``: class quotas of the training size by largest remainder."""
    return f"""
    WITH src AS ({source}),
    cls AS (SELECT {label} AS c, count(*) AS n_c FROM src GROUP BY 1),
    tot AS (SELECT *, sum(n_c) OVER () AS n FROM cls),
    sized AS (SELECT *, n - ceil({test_size} * n) AS n_train FROM tot),
    base AS (SELECT *, CAST(n_c * n_train AS BIGINT) // CAST(n AS BIGINT) AS q,
                    CAST(n_c * n_train AS BIGINT) % CAST(n AS BIGINT) AS rest FROM sized),
    ranked AS (SELECT *, row_number() OVER (ORDER BY rest DESC, c) AS r, sum(q) OVER () AS given FROM base),
    quota AS (SELECT c, q + CASE WHEN r <= n_train - given THEN 1 ELSE 0 END AS quota FROM ranked),
    idx AS (SELECT *, {index_sql(keys, seed, label)} AS idx FROM src)
    SELECT idx.* EXCLUDE (idx), idx.idx >= quota AS is_test FROM idx JOIN quota ON {label} = c
    """


def stratified_fold_sql(
    source: str, keys: Sequence[str], label: str, k: int, seed: object = 42, name: str = "fold"
) -> str:
    """Rows with a stratified fold: class sizes per fold by dealing the sorted table out."""
    upto = lambda x, i: f"(({x} + {k - 1 - i}) // {k})"
    size = lambda i: f"({upto('hi', i)} - {upto('lo', i)})"
    ends = [" + ".join(size(j) for j in range(i + 1)) for i in range(k - 1)]
    fold = " + ".join(f"CASE WHEN idx >= {e} THEN 1 ELSE 0 END" for e in ends)
    return f"""
    WITH src AS ({source}),
    cls AS (SELECT {label} AS c, count(*) AS n_c FROM src GROUP BY 1),
    spans AS (SELECT c, CAST(sum(n_c) OVER (ORDER BY c) AS BIGINT) AS hi,
                     CAST(sum(n_c) OVER (ORDER BY c) - n_c AS BIGINT) AS lo FROM cls),
    idx AS (SELECT *, {index_sql(keys, seed, label)} AS idx FROM src)
    SELECT idx.* EXCLUDE (idx), CAST({fold} AS INTEGER) AS {name} FROM idx JOIN spans ON {label} = c
    """


def edges_sql(source: str, numbers: Sequence[str], impute: bool = True) -> str:
    steps = ", ".join(str(i / BINS) for i in range(1, BINS))
    read = lambda c: f"coalesce({c}, 0)" if impute else c
    picks = ", ".join(f"quantile_disc({read(c)}, [{steps}]) AS e_{c}" for c in numbers) or "1 AS e_none"
    return f"SELECT {picks} FROM ({source})"


def weights_sql(
    folded: str,
    keys: Sequence[str],
    label: str,
    numbers: Sequence[str],
    categories: Sequence[str],
    k: int,
    impute: bool = True,
    edges: str | None = None,
    fold: str = "fold",
) -> str:
    """CTEs ``folded`` .. ``rw``: (row_id, y, fold, feature, w) for every scored row.

    Rows with a NULL fold only train.
    """
    key = key_sql(keys)
    read = lambda c: f"coalesce({c}, 0)" if impute else c
    pieces = []
    for c in numbers:
        crossed = " + ".join(
            f"CAST({read(c)} > e_{c}[{i}] AS INTEGER)" for i in range(1, BINS)
        )
        pieces.append(
            f"SELECT {key} AS row_id, {label} AS y, {fold} AS fold, '{c}' AS feature, "
            f"CAST({crossed} AS VARCHAR) AS value FROM folded, edges"
        )
    for c in categories:
        pieces.append(
            f"SELECT {key} AS row_id, {label} AS y, {fold} AS fold, '{c}' AS feature, "
            f"CAST({c} AS VARCHAR) AS value FROM folded"
        )
    return f"""
    folded AS ({folded}),
    edges AS ({edges or edges_sql('SELECT * FROM folded', numbers, impute)}),
    long AS ({' UNION ALL '.join(pieces)}),
    counted AS (SELECT feature, value, fold, sum(y) AS p, sum(1 - y) AS n FROM long GROUP BY ALL),
    sizes AS (SELECT feature, count(DISTINCT coalesce(value, '~missing~')) AS size FROM counted GROUP BY 1),
    fs AS (SELECT range AS f FROM range({k})),
    trained AS (SELECT feature, value, f,
                       coalesce(sum(p) FILTER (WHERE fold IS DISTINCT FROM f), 0) AS p,
                       coalesce(sum(n) FILTER (WHERE fold IS DISTINCT FROM f), 0) AS n
                FROM counted, fs GROUP BY ALL),
    classes AS (SELECT feature, f, sum(p) AS all_p, sum(n) AS all_n FROM trained GROUP BY ALL),
    ws AS (SELECT feature, value, f,
                  CASE WHEN p + n > 0 THEN CAST(round((ln((p + 1) / (all_p + size)) - ln((n + 1) / (all_n + size)))
                       * {UNIT}) AS BIGINT) ELSE 0 END AS w
           FROM trained JOIN classes USING (feature, f) JOIN sizes USING (feature)),
    rw AS (SELECT row_id, y, fold, long.feature, ws.w
           FROM long JOIN ws ON long.feature = ws.feature AND long.fold = ws.f
                AND long.value IS NOT DISTINCT FROM ws.value
           WHERE fold IS NOT NULL)
    """


def auc_sql(source: str, by: Sequence[str] = (), score: str = "score", label: str = "y") -> str:
    """AUC per group of a subquery with a 0/1 label and a score."""
    groups = ", ".join(by)
    lead = f"{groups}, " if by else ""
    part = f"PARTITION BY {groups} " if by else ""
    return f"""
    SELECT {lead}sum(pos * (less + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0) AS auc
    FROM (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less
          FROM (SELECT {lead}{score} AS s, sum({label})::DOUBLE AS pos, sum(1 - {label})::DOUBLE AS neg
                FROM ({source}) WHERE {label} IS NOT NULL AND {score} IS NOT NULL GROUP BY {lead}{score}))
    {'GROUP BY ' + groups if by else ''}
    """


def best_accuracy_sql(source: str, by: Sequence[str], name: str = "accuracy") -> str:
    """Accuracy per group at its best threshold: every distinct score is tried, and one below all."""
    groups = ", ".join(by)
    return f"""
    SELECT {groups}, max(greatest(ahead, 0) + all_pos) / any_value(all_n) AS {name}
    FROM (SELECT *, sum(neg - pos) OVER (PARTITION BY {groups} ORDER BY score ROWS UNBOUNDED PRECEDING) AS ahead,
                 sum(pos) OVER (PARTITION BY {groups}) AS all_pos, sum(pos + neg) OVER (PARTITION BY {groups}) AS all_n
          FROM (SELECT {groups}, score, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM ({source}) GROUP BY {groups}, score))
    GROUP BY {groups}"""


def neg_log_loss_sql(source: str, by: Sequence[str], name: str = "neg_log_loss") -> str:
    groups, z = ", ".join(by), f"(score / {float(UNIT)})"
    return f"""
    SELECT {groups}, -avg(CASE WHEN y = 1 THEN ln(1 + exp(-{z})) ELSE ln(1 + exp({z})) END) AS {name} FROM ({source}) GROUP BY {groups}"""


METRIC_SQL = {"auc": auc_sql, "accuracy": best_accuracy_sql, "neg_log_loss": neg_log_loss_sql}


def sequential_sql(
    folded: str, keys: Sequence[str], label: str, numbers: Sequence[str], categories: Sequence[str], k: int,
    direction: str, metric: str = "auc",
) -> str:
    """The steps of sequential selection, one after the other: each tries every feature left."""
    features = [*numbers, *categories]
    forward = direction == "forward"
    listed = ", ".join(f"({i}, '{f}')" for i, f in enumerate(features))
    start = "[]::VARCHAR[]" if forward else "[" + ", ".join(f"'{f}'" for f in features) + "]"
    counts = (
        "CASE WHEN feature = c.name OR list_contains(chosen, feature) THEN w ELSE 0 END" if forward
        else "CASE WHEN feature <> c.name AND list_contains(chosen, feature) THEN w ELSE 0 END"
    )
    steps = len(features) // 2 if forward else len(features) - len(features) // 2
    parts = [f"candidates(place, name) AS (VALUES {listed})", f"set0 AS (SELECT {start} AS chosen)"]
    for i in range(1, steps + 1):
        scored = f"""
            SELECT c.name, place, row_id, any_value(y) AS y, any_value(fold) AS fold, sum({counts}) AS score
            FROM rw, candidates c, set{i - 1} WHERE list_contains(chosen, c.name) <> {forward} GROUP BY c.name, place, row_id"""
        parts.append(f"""best{i} AS (
            SELECT name, avg({metric}) AS m FROM ({METRIC_SQL[metric](scored, ["name", "place", "fold"])}) GROUP BY name, place
            ORDER BY round(m, 6) DESC, place LIMIT 1)""")
        after = f"list_append(chosen, name)" if forward else "list_filter(chosen, lambda x: x <> name)"
        parts.append(f"set{i} AS (SELECT {after} AS chosen FROM set{i - 1}, best{i})")
    out = " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS step, name AS feature, round(m, 6) AS {metric} FROM best{i}" for i in range(1, steps + 1))
    return f"WITH {weights_sql(folded, keys, label, numbers, categories, k)}, {', '.join(parts)} {out}"


def nb_fold_auc_sql(
    folded: str, keys: Sequence[str], label: str, numbers: Sequence[str], categories: Sequence[str],
    k: int, impute: bool = True, edges: str | None = None, fold: str = "fold",
) -> str:
    """(fold, auc) of the naive Bayes scorer."""
    ctes = weights_sql(folded, keys, label, numbers, categories, k, impute, edges, fold)
    scored = "SELECT row_id, any_value(y) AS y, any_value(fold) AS fold, sum(w) AS score FROM rw GROUP BY row_id"
    return f"WITH {ctes} SELECT fold, auc FROM ({auc_sql(scored, ['fold'])})"


def noise_sql(keys: Sequence[str], i: int) -> str:
    digits = f"substr({hash_sql(keys, NOISE_SEED, i)}, 1, 13)"
    return f"('0x' || {digits})::BIGINT / {float(2**52)}"


def importance_sql(
    folded: str, keys: Sequence[str], label: str, numbers: Sequence[str], categories: Sequence[str],
    k: int,
) -> str:
    """(fold, feature, importance); each row gets the values of the next one of its fold in a hash order."""
    features = [*numbers, *categories]
    ctes = weights_sql(folded, keys, label, numbers, categories, k)
    pivot = ", ".join(f"sum(w) FILTER (WHERE feature = '{f}') AS w{i}" for i, f in enumerate(features))
    ring = "PARTITION BY fold ORDER BY h"
    nexts = ", ".join(
        f"coalesce(lead(w{i}) OVER ({ring}), first_value(w{i}) OVER ({ring})) AS p{i}"
        for i in range(len(features))
    )
    total = " + ".join(f"w{i}" for i in range(len(features)))
    variants = " UNION ALL ".join(
        [f"SELECT fold, '__base' AS feature, y, {total} AS score FROM swapped"]
        + [
            f"SELECT fold, '{f}' AS feature, y, {total} - w{i} + p{i} AS score FROM swapped"
            for i, f in enumerate(features)
        ]
    )
    return f"""
    WITH {ctes},
    wide AS (SELECT row_id, any_value(y) AS y, any_value(fold) AS fold,
                    md5(concat_ws('|', row_id, '{PERMUTE_SEED}')) AS h, {pivot} FROM rw GROUP BY row_id),
    swapped AS (SELECT *, {nexts} FROM wide),
    variants AS ({variants}),
    aucs AS ({auc_sql('SELECT * FROM variants', ['fold', 'feature'])})
    SELECT a.fold, a.feature, b.auc - a.auc AS importance
    FROM aucs a JOIN aucs b ON a.fold = b.fold AND b.feature = '__base' WHERE a.feature <> '__base'
    """
