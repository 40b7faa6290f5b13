"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

The terms of a text are its words, weighted by how often they occur. A sample is a pair (term,
number) with a number from 1 to the term's weight: of all such pairs of a text the one with the
least draw, where a draw depends on the pair and the sample's number only. Every pair is equally
likely, and two texts agree in a sample with a probability equal to the generalised Jaccard
similarity of their weighted terms.

Few draws can be the least of a text, so the others are not worked out. Hashes of the pair give
words of 64 random bits, a bit for each of 64 samples: a draw is smaller the more words from the
first on have its bit set, then by a hash of pair and sample. A text of n pairs enters the draws
with as many set bits as leave 10 to 20 pairs for each sample on average, but no more than
``LEVELS``. A sample for which none is left (by calculation at most 0.6 % of texts have one) is
worked out from all pairs of the text, so each sample is the least of all draws.

Counts come from a sorted array inside the row, so terms are never shuffled; the least values
are a grouped minimum within the ranges in which the texts already lie. A document's text and
its edited text share most terms, and a term they share draws once for both.

The share of samples that agree has a standard error of sqrt(p (1 - p) / SAMPLES) at a true
likeness of p: at most 0.044 with 128 samples.

Defined results: a null text is the empty text; texts without words have the fingerprint of
``-`` signs, alike with each other (1.0) and unlike all others (0.0); rows that repeat an id
follow each other by text; null ids come first; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from columnwright.llm.ranges import id_ranges

SAMPLES = 128
# Words of random bits that a draw goes by before its hash.
LEVELS = 12
# Pairs wanted for each sample at least, on average.
LEAST = 10
SEPARATORS = r"[\x20\x09-\x0D]+"
RANGE_BYTES = 16_000_000
# What a document weighs besides its text: its samples take memory however short it is.
DOCUMENT_BYTES = 4096
LOW = (1 << 32) - 1
# Greater than any draw.
NONE = (1 << 63) - 1


def hashes(text: Column, tag: int = 0) -> Column:
    """The hashes of a text's words, repeats included; the lowest bit is ``tag``."""
    words = F.array_remove(F.split(text, SEPARATORS), "")
    return F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(tag)))


def sorted_terms(text: Column) -> Column:
    """The hashes of a text's words, sorted, repeats included."""
    return F.sort_array(hashes(text))


def _pair(term: Column, number: Column) -> Column:
    return F.xxhash64(term, number.cast("int"))


def _words(pair: Column, word: Column) -> list[Column]:
    """``LEVELS`` words of random bits for the samples from 64 * ``word`` on."""
    return [F.xxhash64(pair, F.lit(-i) - word * LEVELS) for i in range(1, LEVELS + 1)]


def _draw(pair: Column, sample: Column, set_bits: Column) -> Column:
    """The draw in 31 bits (those not set first, then a hash), and 32 bits that name the pair."""
    rest = F.xxhash64(pair, sample).bitwiseAND(F.lit((1 << 59) - 1 - LOW))
    above = F.shiftleft((F.lit(LEVELS) - set_bits).cast("long"), 59)
    return above.bitwiseOR(rest).bitwiseOR(pair.bitwiseAND(F.lit(LOW)))


def _whole_draw(pair: Column, sample: Column) -> Column:
    """The draw of a pair for a sample, from nothing else."""
    shift = F.pmod(sample, F.lit(64)).cast("int")
    set_bits, still = F.lit(0).cast("long"), F.lit(1).cast("long")
    words = _words(pair, (sample / 64).cast("int"))
    # Bits count up to the first that is not set.
    level = F.lit(LEVELS)
    for i in reversed(range(LEVELS)):
        level = F.when(_bit(words[i], shift) == 0, i).otherwise(level)
    return _draw(pair, sample, level)


def _bit(word: Column, shift: Column) -> Column:
    return F.call_function("shiftrightunsigned", word, shift).bitwiseAND(F.lit(1))


def _level(n: Column) -> Column:
    """Bits that are to be set in a draw that a text of ``n`` pairs enters."""
    return F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.floor(F.log2(F.greatest(n, F.lit(1)) / F.lit(LEAST))).cast("int")))


def _entered(pairs: DataFrame, keep: list[str], samples: int) -> DataFrame:
    """``keep``, ``__sample`` and ``__draw`` of the draws of every ``__pair`` with ``__level`` bits set.

    Each step is a projection of its own, so that Spark works out what later steps read more than
    once only once.
    """
    levels = range(1, LEVELS + 1)
    keep = [*keep, "__pair"]
    words = pairs.select("*", F.explode(F.array(*[F.lit(i) for i in range(-(-samples // 64))])).alias("__word"))
    words = words.select(
        *keep, "__level", "__word", *[w.alias(f"__w{i}") for i, w in zip(levels, _words(F.col("__pair"), F.col("__word")))]
    )
    masks, mask = [], None
    for i in levels:
        mask = F.col(f"__w{i}") if mask is None else mask.bitwiseAND(F.col(f"__w{i}"))
        masks.append(mask.alias(f"__m{i}"))
    masked = words.select(*keep, "__level", "__word", *masks)
    entering = F.lit(-1).cast("long")
    for i in levels:
        entering = F.when(F.col("__level") >= i, F.col(f"__m{i}")).otherwise(entering)
    names = [f"__m{i}" for i in levels]
    masked = masked.select(*keep, "__word", *names, entering.alias("__mask"))
    # Eight samples at a time first: most of them have no bit.
    eights = masked.select("*", F.explode(F.array(*[F.lit(8 * i) for i in range(8)])).alias("__eight")).where(
        F.call_function("shiftrightunsigned", F.col("__mask"), F.col("__eight")).bitwiseAND(F.lit(255)) != 0
    )
    bits = eights.select(*keep, "__word", *names, "__mask", "__eight", F.explode(F.array(*[F.lit(i) for i in range(8)])).alias("__one"))
    bits = bits.where(_bit(F.col("__mask"), F.col("__eight") + F.col("__one")) == 1)
    placed = bits.select(*keep, *names, (F.col("__eight") + F.col("__one")).alias("__shift"), "__word")
    set_bits = sum((_bit(F.col(m), F.col("__shift")) for m in names[1:]), _bit(F.col(names[0]), F.col("__shift")))
    counted = placed.select(*keep, (F.col("__word") * 64 + F.col("__shift")).alias("__sample"), set_bits.alias("__set"))
    if samples % 64:
        counted = counted.where(F.col("__sample") < samples)
    return counted.select(*keep[:-1], "__sample", _draw(F.col("__pair"), F.col("__sample"), F.col("__set")).alias("__draw"))


def _least_of_all(terms: Column, wanted: Column) -> Column:
    """The least draws of a text for the samples ``wanted``, from all its pairs."""
    start = F.struct(F.lit(0).cast("long").alias("term"), F.lit(0).alias("number"),
                     F.transform(wanted, lambda j: F.lit(NONE)).alias("least"))

    def step(state: Column, term: Column) -> Column:
        number = F.when(state["term"] == term, state["number"]).otherwise(0) + F.lit(1)
        pair = _pair(term, number)
        return F.struct(term.alias("term"), number.alias("number"), F.zip_with(
            state["least"], wanted, lambda least, j: F.least(least, _whole_draw(pair, j))
        ).alias("least"))

    return F.aggregate(terms, start, step, lambda state: state["least"])


def signatures(
    rows: DataFrame, key: str | Sequence[str], terms: str, samples: int = SAMPLES,
    carry: tuple[str, ...] = (), texts: int = 1,
) -> DataFrame:
    """``key``, ``signature`` (array of ``samples`` integers) and ``digits`` (the same as text) of every row that has terms.

    ``terms`` is a sorted array of hashes; ``carry`` names columns of whole numbers that go along.
    With two ``texts`` the lowest bit of a hash tells the text it is from, and the signature of
    the second (null if it has no terms) is ``signature1``; a term of both draws once. ``key`` is
    one column or several; if rows lie together by some of them, nothing is shuffled.
    """
    key = [key] if isinstance(key, str) else list(key)
    # Unnesting a list of one makes Spark work out the array once, not once per reference.
    rows = rows.select(*key, *carry, F.explode(F.array(F.col(terms))).alias(terms))
    carried = rows.select(*key, *carry, F.col(terms).alias("__terms"))
    n = F.size(terms)
    last = F.filter(
        F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get(F.col(terms), i) != F.get(F.col(terms), i - 1))
    )
    first_n = n if texts == 1 else F.size(F.filter(terms, lambda t: t.bitwiseAND(F.lit(1)) == 0))
    sized = rows.where(n > 0).select(*key, terms, F.explode(F.array(F.struct(last.alias("ends"), first_n.alias("n")))).alias("__of"))
    levels = [f"__level{i}" for i in range(texts)]
    runs = sized.select(*key, terms, F.col("__of.ends").alias("__ends"), *[
        _level(c).alias(name) for c, name in zip([F.col("__of.n"), n - F.col("__of.n")], levels)
    ])
    each = runs.select(*key, terms, "__ends", *levels, F.posexplode("__ends").alias("__at", "__end"))
    end = lambda back: F.coalesce(F.get(F.col("__ends"), F.col("__at") - back), F.lit(0))
    term = F.get(F.col(terms), F.col("__end") - 1)
    plain = lambda x: x.bitwiseAND(F.lit(-2))
    own = F.col("__end") - end(1)
    if texts == 1:
        weights = [own]
    else:
        # A run of the first text is left to the run of the second that follows it, if any does.
        each = each.where(
            (term.bitwiseAND(F.lit(1)) == 1)
            | ~F.coalesce(F.get(F.col(terms), F.col("__end")) == term + 1, F.lit(False))
        )
        second = term.bitwiseAND(F.lit(1)) == 1
        before = F.when(F.get(F.col(terms), end(1) - 1) == plain(term), end(1) - end(2)).otherwise(0)
        weights = [F.when(second, before).otherwise(own), F.when(second, own).otherwise(0)]
    counts = [f"__weight{i}" for i in range(texts)]
    weighted = each.select(*key, *levels, plain(term).alias("__term"), *[w.alias(c) for w, c in zip(weights, counts)])
    most = F.col(counts[0]) if texts == 1 else F.greatest(*counts)
    numbered = weighted.select("*", F.explode(F.sequence(F.lit(1), most)).alias("__number"))
    has = [F.col("__number") <= F.col(c) for c in counts]
    level = F.col(levels[0]) if texts == 1 else (
        F.when(has[0] & has[1], F.least(*levels)).when(has[0], F.col(levels[0])).otherwise(F.col(levels[1]))
    )
    # A text takes draws of its own level only: below it those of pairs that it has alone are left out.
    tops = [f"__top{i}" for i in range(texts)]
    pairs = numbered.select(
        *key, *[F.when(h, F.lit(LEVELS) - F.col(x)).otherwise(-1).alias(top) for h, x, top in zip(has, levels, tops)],
        level.alias("__level"), _pair(F.col("__term"), F.col("__number")).alias("__pair"),
    )
    entered = _entered(pairs, [*key, *tops], samples)
    draws = [f"__draw{i}" for i in range(texts)]
    least = entered.groupBy(*key, "__sample").agg(
        *[F.min(F.when(F.shiftright("__draw", 59) <= F.col(top), F.col("__draw")).otherwise(NONE)).alias(d) for top, d in zip(tops, draws)]
    )
    parts = least.select(*key, F.struct("__sample", *draws).alias("__part"))
    # Columns that go along, and the terms for samples without a draw, join here: in the aggregate
    # above they would take most of its time.
    # Both sides lie by the same columns, so the union does too, and nothing is shuffled.
    parts = parts.unionByName(carried, allowMissingColumns=True)
    found = parts.groupBy(*key).agg(
        F.sort_array(F.collect_list("__part")).alias("__parts"),
        F.first("__terms", ignorenulls=True).alias("__terms"), *[F.min(c).alias(c) for c in carry],
    ).where(F.size("__terms") > 0)
    numbers = F.sequence(F.lit(0), F.lit(samples - 1))
    of_text = lambda d: F.filter("__parts", lambda x: x[d] != NONE)
    entries = [of_text(d) for d in draws]
    missing = found.select("*", *[
        F.when(F.size(e) < samples, F.array_except(numbers, F.transform(e, lambda x: x["__sample"]))).alias(f"__missing{i}")
        for i, e in enumerate(entries)
    ])

    def signature(i: int) -> Column:
        entered = F.transform(entries[i], lambda x: F.struct(x["__sample"].alias("sample"), x[draws[i]].alias("draw")))
        of = F.col("__terms") if texts == 1 else F.filter("__terms", lambda t: t.bitwiseAND(F.lit(1)) == i)
        rest = F.zip_with(
            F.col(f"__missing{i}"), _least_of_all(F.transform(of, plain), F.col(f"__missing{i}")),
            lambda j, draw: F.struct(j.alias("sample"), draw.alias("draw")),
        )
        all_ = F.when(F.col(f"__missing{i}").isNull(), entered).when(
            F.size(of) > 0, F.sort_array(F.concat(entered, rest))
        )
        return F.transform(all_, lambda x: x["draw"].bitwiseAND(F.lit(LOW)))

    signed = missing.select(*key, *carry, *[signature(i).alias(f"signature{i or ''}") for i in range(texts)])
    return signed.select("*", *[
        F.lower(F.array_join(F.transform(f"signature{i or ''}", lambda x: F.lpad(F.hex(x), 8, "0")), "")).alias(f"digits{i or ''}")
        for i in range(texts)
    ])


def as_text(digits: Column, samples: int = SAMPLES) -> Column:
    """Eight hexadecimal digits per sample; signs for a text without words."""
    return F.coalesce(digits, F.lit("-" * 8 * samples))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of samples that agree: an estimate of the generalised Jaccard similarity."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / F.lit(float(samples)))


def _weighed(plain: DataFrame) -> DataFrame:
    """A row for each ``DOCUMENT_BYTES`` of a document's weight, so that a sketch of ids goes by weight."""
    units = (F.lit(1) + F.floor(F.octet_length("text") / DOCUMENT_BYTES)).cast("int")
    return plain.select("doc_id", F.explode(F.array_repeat(F.lit(DOCUMENT_BYTES), units)).alias("bytes"))


def _spread(spark: SparkSession, n: int) -> list[int]:
    """``n`` different numbers that ``repartition(n)`` by the number deals one to each partition.

    Of 32 candidates for each partition none fits with a probability of e^-32; such a partition
    stays empty, and another has two numbers.
    """
    part = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
    found = [r["id"] for r in spark.range(32 * n).groupBy(part).agg(F.min("id").alias("id")).collect()]
    return [*found, *range(32 * n, 33 * n - len(found))]


def with_next(documents: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), ``range``, ``place`` in it, and the text of the next document.

    Ranges of ids are ordered on their own; the first document of each range stands once more
    at the end of the range before it (of the last one for the first) with ``border`` 1, so every
    row finds its follower in its own range. Texts are shuffled once. A range is a partition of
    its own, whatever the session's number of partitions: what a task holds follows from the
    weight of a range.
    """
    plain = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spark = documents.sparkSession
    ranges = id_ranges(_weighed(plain), F.col("bytes"), RANGE_BYTES)
    labels = _spread(spark, ranges.count)
    label = spark.createDataFrame(list(enumerate(labels)), "number int, range int")
    marked = (
        ranges.mark(plain, "number").join(F.broadcast(label), "number")
        .select("doc_id", "text", "number", "range", F.lit(0).alias("border"))
    )
    # One row per range; the text is looked up for these ids only.
    lowest = marked.groupBy("number").agg(F.min("doc_id").alias("id"), F.max(F.col("doc_id").isNull()).alias("open"))
    heads = {r["number"]: None if r["open"] else r["id"] for r in lowest.collect()}
    order = sorted(heads)
    before = {r: order[i - 1] for i, r in enumerate(order)}
    if not order:
        return marked.select("doc_id", "text", "range", "border", F.lit(0).alias("place"), F.col("text").alias("next_text"))
    names = spark.createDataFrame(
        [(labels[r], heads[r], labels[before[r]]) for r in order], f"range int, id {documents.schema['doc_id'].dataType.simpleString()}, to int"
    )
    first = (
        marked.join(F.broadcast(names), "range").where(F.col("doc_id").eqNullSafe(F.col("id")))
        .groupBy("range", "to").agg(F.min("text").alias("text"))
        .select(F.lit(None).cast(documents.schema["doc_id"].dataType).alias("doc_id"), "text", F.col("to").alias("range"), F.lit(1).alias("border"))
    )
    along = Window.partitionBy("range").orderBy("border", F.col("doc_id").asc_nulls_first(), "text")
    return (
        marked.select("doc_id", "text", "range", "border").unionByName(first).repartition(ranges.count, "range")
        .withColumn("place", F.row_number().over(along)).withColumn("next_text", F.lead("text").over(along))
    )


def _sha_parts(text: Column) -> list[Column]:
    """SHA-256 as four signed longs, which a hash aggregate can carry."""
    digest = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(digest, 16 * i + 1, 16), 16, -10).cast("long").alias(f"sha{i}") for i in range(4)]


def edited_likeness(documents: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many
    (or all) of the next document, ascending doc_id; after the last comes the first.
    """
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    rows = with_next(documents).select(
        "range", "place", "border", "doc_id", "text", n.cast("long").alias("n_chars"),
        F.coalesce(edited, F.lit("")).alias("edited"),  # a border row has no next text
    )
    both = rows.select(
        "range", "place", "border", "doc_id", "n_chars", *_sha_parts(F.col("edited")),
        F.explode(F.array(F.struct(hashes(F.col("text"), 0).alias("a"), hashes(F.col("edited"), 1).alias("b")))).alias("one"),
    )
    bare, bare1 = F.size("one.a") == 0, F.size("one.b") == 0
    # A made-up term keeps the rows without words; their signature is dropped afterwards.
    ready = both.select(
        "range", "place", "border", "doc_id", "n_chars", "sha0", "sha1", "sha2", "sha3",
        bare.cast("int").alias("bare"), bare1.cast("int").alias("bare1"),
        F.when(bare & bare1, F.array(F.lit(0).cast("long")))
        .otherwise(F.sort_array(F.concat("one.a", "one.b"))).alias("terms"),
    )
    carry = ("border", "doc_id", "n_chars", "sha0", "sha1", "sha2", "sha3", "bare", "bare1")
    # Rows lie by range already, and the border row stands for the next range: no join, no shuffle.
    found = signatures(ready, ("range", "place"), "terms", samples, carry, texts=2)
    own = lambda c: F.when(F.col("bare") == 0, F.col(c))
    other = lambda c: F.when(F.col("bare1") == 0, F.col(c))
    along = Window.partitionBy("range").orderBy("place")
    joined = (
        found.withColumns({"signature": own("signature"), "edited": other("signature1"), "digits": own("digits"), "digits1": other("digits1")})
        .withColumn("after", F.lead("signature").over(along)).where("border = 0")
    )
    sha = F.lower(F.concat(*[F.lpad(F.hex(f"sha{i}"), 16, "0") for i in range(4)]))
    return joined.select(
        "doc_id", "n_chars", sha.alias("edited_sha256"), as_text(F.col("digits"), samples).alias("fingerprint"),
        as_text(F.col("digits1"), samples).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited"), samples).alias("near_edited"),
        likeness(F.col("signature"), F.col("after"), samples).alias("near_next"),
    )
