"""Personal data: base patterns, high-recall generators, boosted trees and calibrated thresholds; built-in functions only."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from statloom.llm.base import KEY, join_documents, keyed, query, table
from statloom.sources.landing import land, landings

BASE_KINDS = ("email", "ip", "card", "phone")
# A match must begin where a run of its first class begins, or where the match before ended; elsewhere it cannot succeed
# if it failed at the run's begin. Groups that repeat are possessive, so long runs need no deep recursion.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE_HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
# generators of further candidates; they may overlap each other and the base spans
WIDER = {
    "number": r"(?<![0-9A-Za-z.])[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}+(?![0-9A-Za-z])",
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "token": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+(?![A-Za-z0-9_-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
}
WIDER_HINT = {"number": r"[0-9]", "mail": r"(?i)\bat\b|[\[(]at[\])]", "token": r"[A-Za-z0-9_-]{20}", "account": r"[A-Z]{2}[0-9]{2}"}
PRECISION = 0.9
SPANS = "array<struct<s:bigint,e:bigint,m:string>>"


def _cut(text: Column, pattern: str) -> Column:
    """(s, e, m) of all leftmost, non-overlapping matches, in code points. Marks stand in for the two control
    characters they use, which no pattern matches, so places do not move."""
    marked = F.regexp_replace(F.translate(text, "\x01\x02", "\x03\x03"), f"({pattern})", "\x01$1\x02")
    parts = F.split(marked, "\x01")
    begin = F.struct(F.char_length(F.get(parts, F.lit(0))).cast("bigint").alias("p"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        m = F.substring_index(part, "\x02", 1)
        span = F.struct(acc.p.alias("s"), (acc.p + F.char_length(m)).alias("e"), m.alias("m"))
        return F.struct((acc.p + F.char_length(part) - 1).alias("p"), F.array_append(acc.out, span).alias("out"))

    return F.aggregate(F.slice(parts, 2, F.greatest(F.lit(1), F.size(parts))), begin, step, lambda acc: acc.out)


def _none() -> Column:
    return F.array().cast(SPANS)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1)), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    digits = _digits(m)
    if kind == "card":
        return F.when(F.char_length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    return F.char_length(digits).between(10, 15)


def _accepts(kind: str):
    return lambda x: _valid(kind, x.m)


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with one array column per base kind."""
    has_digit = F.col("text").rlike("[0-9]")
    for kind in BASE_KINDS:
        maybe = F.col("text").contains(BASE_HINT[kind]) if BASE_HINT[kind] else F.lit(True)
        if kind != "email":
            maybe = maybe & has_digit
        cut = _cut(F.col("text"), BASE[kind])
        docs = docs.withColumn(kind, F.when(maybe, F.filter(cut, _accepts(kind))).otherwise(_none()))
    return docs


def _with_context(kind: str):
    return lambda x: F.struct(
        F.lit(kind).alias("kind"), x.s.alias("s"), x.e.alias("e"), x.m.alias("m"),
        F.substring(F.col("text"), F.greatest(F.lit(1), x.s - 23).cast("int"), F.least(F.lit(24), x.s).cast("int")).alias("before"),
        F.substring(F.col("text"), (x.e + 1).cast("int"), F.lit(12)).alias("after"),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """(doc key, kind, s, e, m, before, after) of every generator's matches, the base patterns' failing ones included."""
    out = None
    for kind, pattern in {**{k: BASE[k] for k in ("ip", "card", "phone")}, **WIDER}.items():
        hint = F.col("text").rlike(WIDER_HINT[kind] if kind in WIDER else r"[0-9]")
        if kind in BASE and BASE_HINT[kind]:
            hint = hint & F.col("text").contains(BASE_HINT[kind])
        one = F.transform(_cut(F.col("text"), pattern), _with_context(kind))
        column = F.when(hint, one).otherwise(F.array().cast("array<struct<kind:string,s:bigint,e:bigint,m:string,before:string,after:string>>"))
        out = column if out is None else F.concat(out, column)
    return docs.select(*KEY, F.explode(out).alias("c")).select(*KEY, "c.*")


FEATURES = {
    "length": lambda: F.char_length("m"),
    "digits": lambda: F.char_length(_digits(F.col("m"))),
    "letters": lambda: F.char_length(F.regexp_replace("m", "[^A-Za-z]", "")),
    "dots": lambda: F.char_length(F.regexp_replace("m", r"[^.]", "")),
    "dashes": lambda: F.char_length(F.regexp_replace("m", r"[^-]", "")),
    "blanks": lambda: F.char_length(F.regexp_replace("m", r"[^ ]", "")),
    "brackets": lambda: F.char_length(F.regexp_replace("m", r"[^()]", "")),
    "plus": lambda: F.when(F.col("m").startswith("+"), 1).otherwise(0),
    "zero_first": lambda: F.when(F.col("m").rlike(r"^[+(]?0"), 1).otherwise(0),
    "different": lambda: F.size(F.array_distinct(F.split("m", ""))),
    "contact_word": lambda: F.when(F.lower("before").rlike(r"tel|phone|call|fax|mobil|mail|contact|kontakt|llam"), 1).otherwise(0),
    "secret_word": lambda: F.when(F.lower("before").rlike(r"key|token|secret|passw|pwd|iban|konto|card|karte"), 1).otherwise(0),
    "joined_left": lambda: F.when(F.col("before").rlike(r"[A-Za-z0-9=/#_.-]$"), 1).otherwise(0),
    "joined_right": lambda: F.when(F.col("after").rlike(r"^[A-Za-z0-9/#_-]"), 1).otherwise(0),
    "digits_near": lambda: F.char_length(_digits(F.concat("before", "after"))),
    "money_near": lambda: F.when(F.concat("before", "after").rlike(r"[$%€£]"), 1).otherwise(0),
}


def _weak_label() -> Column:
    """What the validators say: 1 accepted, 0 refused, null where no validator speaks."""
    m, kind = F.col("m"), F.col("kind")
    label = F.lit(None).cast("double")
    for k in ("ip", "card", "phone"):
        label = F.when(kind == k, _valid(k, m).cast("double")).otherwise(label)
    credential = F.lower("before").rlike(r"(key|token|secret|passw|pwd)\S*[\s:=\"']*$")
    plain = m.rlike(r"^[a-z-]+$") | (F.size(F.array_distinct(F.split("m", ""))) < 6)
    return F.when((kind == "token") & credential, 1.0).when((kind == "token") & plain, 0.0).otherwise(label)


def personal_data(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """Personal data in each document.

    Returns per row: doc_id, _rk, email, ip, card, phone (arrays of s, e, m: the base spans, in code points, end
    exclusive) and more (spans that the trees accept: kind, s, e, m). Trees are fitted on all candidates
    that the validators label but a third, kept by a digest for calibration; only the places where a tree may split come from
    Spark's own quantiles of a feature, over 10,000 rows or more. Calibration reads its whole third: per kind
    the lowest score from which on ``precision`` of the calibration rows are right. Kinds without a
    labelled row use the threshold over all kinds; without both labels nothing is added. Base spans are never removed.
    A null text is empty and has no spans; repeated rows get equal answers; an empty table gives no rows.
    """
    docs = keyed(docs)
    with landings() as own:
        more = _accepted(docs, precision)
        own.only(more)
    out = join_documents(base_spans(docs).drop("text"), more)
    return out.withColumn("more", F.coalesce("more", F.array().cast("array<struct<s:bigint,kind:string,e:bigint,m:string>>")))


def _accepted(docs: DataFrame, precision: float) -> DataFrame:
    """(doc key, more): the candidates that the trees accept."""
    found = candidates(docs)
    for name, make in FEATURES.items():
        found = found.withColumn(f"f_{name}", make().cast("double"))
    found = land(found.withColumn("f_kind", F.pmod(F.hash("kind"), F.lit(64)).cast("double")).withColumn("label", _weak_label()).dropDuplicates([*KEY, "kind", "s"]))
    columns = [f"f_{n}" for n in FEATURES] + ["f_kind"]
    assemble = VectorAssembler(inputCols=columns, outputCol="features")
    # written in an order of its own, so that the same candidates give the same trees
    labelled = found.where("label IS NOT NULL").select(*KEY, "s", "kind", "label", *columns, F.pmod(F.xxhash64("m"), F.lit(3)).alias("fold"))
    labelled = land(labelled.repartitionByRange(F.xxhash64(*KEY, "s", "kind")).sortWithinPartitions(F.xxhash64(*KEY, "s", "kind")))
    fit, check = labelled.where("fold > 0"), labelled.where("fold = 0")
    if fit.select("label").distinct().count() == 2 and not check.isEmpty():
        model = GBTClassifier(labelCol="label", featuresCol="features", maxIter=8, maxDepth=3, maxBins=32, seed=7).fit(assemble.transform(fit.select("label", *columns)))

        def scored(rows: DataFrame) -> DataFrame:
            return model.transform(assemble.transform(rows)).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")

        grade = scored(check).select("kind", F.floor(F.col("score") * 100).cast("int").alias("g"), "label")
        grade = grade.unionByName(grade.withColumn("kind", F.lit("*"))).groupBy("kind", "g").agg(F.sum("label").alias("yes"), F.count("*").alias("n")).collect()
        limits = _thresholds([(r.kind, r.g, r.yes, r.n) for r in grade], precision)
        limit = F.lit(limits.get("*", 2.0))
        for kind, value in limits.items():
            if kind != "*":
                limit = F.when(F.col("kind") == kind, F.lit(value)).otherwise(limit)
        accepted = scored(found).where((F.col("score") >= limit) & F.coalesce(F.col("label") > 0, F.lit(True)))
    else:
        accepted = found.where("false")
    return land(accepted.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("s", "kind", "e", "m"))).alias("more")))


def _thresholds(grades: list[tuple[str, int, float, int]], precision: float) -> dict[str, float]:
    """Per kind the lowest hundredth from which on the share of right rows is large enough; above 1 if there is none."""
    out = {}
    for kind in {g[0] for g in grades}:
        yes = n = 0.0
        out[kind] = 2.0
        for _, g, y, k in sorted((x for x in grades if x[0] == kind), key=lambda x: -x[1]):
            yes, n = yes + y, n + k
            if yes >= precision * n:
                out[kind] = g / 100
    return out


def _listed(kinds_and_arrays) -> Column:
    def tagged(i: int, kind: str):
        return lambda x: F.struct(x.s.alias("s"), F.lit(i).alias("i"), F.lit(kind).alias("k"), x.e.alias("e"))

    return F.concat(*[F.transform(a, tagged(i, kind)) for i, (kind, a) in enumerate(kinds_and_arrays)])


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x.k, x.s.cast("string"), x.e.cast("string"))), ",")


def span_lists(found: DataFrame) -> tuple[Column, Column]:
    """(base, all) as text: kind:start:end by start, then kind as listed. A span of the method that repeats a base span is left out."""
    base = _listed([(k, F.col(k)) for k in BASE_KINDS])
    rank = F.lit(len(BASE_KINDS))
    more = F.transform("more", lambda x: F.struct(x.s.alias("s"), rank.alias("i"), x.kind.alias("k"), x.e.alias("e")))
    known = F.transform(base, lambda x: F.concat_ws(":", x.k, x.s.cast("string"), x.e.cast("string")))
    fresh = F.filter(more, lambda x: ~F.array_contains(known, F.concat_ws(":", x.k, x.s.cast("string"), x.e.cast("string"))))
    return _written(base), _written(F.concat(base, fresh))


def _merged(found: DataFrame) -> DataFrame:
    """(doc key, _spans): the base spans and more, sorted, of the documents that have any."""
    spans = F.array_sort(F.concat(
        _listed([(k, F.col(k)) for k in BASE_KINDS]),
        F.transform("more", lambda x: F.struct(x.s.alias("s"), F.lit(len(BASE_KINDS)).alias("i"), x.kind.alias("k"), x.e.alias("e"))),
    ))
    return land(found.select(*KEY, spans.alias("_spans")).where(F.size("_spans") > 0).dropDuplicates(KEY))


def redacted(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with every span found in ``text`` replaced by its kind in angle brackets; other columns as they are.

    Overlapping spans become one, named after the first. Null texts stay null.
    """
    with landings() as own:
        spans = _merged(personal_data(docs, **settings))
        own.only(spans)
    digest = F.xxhash64(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.withColumn("_digest", digest).alias("d").join(spans.alias("r"), (F.col("_digest") == F.col("r._rk")) & F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")), "left")
    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("p"))
    text = F.col("d.text")

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, (acc.p + 1).cast("int"), F.greatest(F.lit(0), x.s - acc.p).cast("int"))
        new = F.concat(acc.out, gap, F.lit("<"), x.k, F.lit(">"))
        return F.struct(F.when(x.s >= acc.p, new).otherwise(acc.out).alias("out"), F.greatest(acc.p, x.e).alias("p"))

    done = F.aggregate(F.col("_spans"), begin, step, lambda acc: F.concat(acc.out, F.substring(text, (acc.p + 1).cast("int"), F.char_length(text))))
    return rows.select(*[F.when(F.col("_spans").isNull(), text).otherwise(done).alias("text") if c == "text" else F.col(f"d.`{c}`").alias(c) for c in docs.columns])


@query("op3_pii_boosted_candidates")
def op3(spark, sf_dir):
    found = personal_data(table(spark, sf_dir, "documents"))
    base, every = span_lists(found)
    return found.select("doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS], F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))
