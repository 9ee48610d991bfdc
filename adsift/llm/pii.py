"""Personal data: patterns, and terms that disclose them by co-occurrence, with DataFrame expressions only.

Addresses, numbers and the like are found by pattern. Corpus counts then tell how strongly a word that stands with such an
entity reveals it: the pointwise mutual information of word and entity over whole documents, against the information the
entity itself holds. A word above the threshold is generalised (a name, a number) or removed wherever it stands in a
document that holds the entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adsift.functions.text import bound
from adsift.session import materialise

KINDS = ("email", "ip", "card", "phone")
TERM = len(KINDS)  # the kind of added spans, after the others
# The contract's patterns, written so that a search does not start inside a run that was tried from its beginning, and
# does not give back what it cannot use: the matches are the same and long runs cost no more than their length.
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold before its pattern is tried.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
WORD = r"[\p{L}\p{N}_]+"

# Surroundings tell copies of a passage apart: code points on either side of an entity, words on either side of a word.
# LEAST_CONTEXTS of them must show a word with an entity; DISCLOSURE is the share of the entity's information that a word may give away.
REACH, BESIDE, LEAST_CONTEXTS, DISCLOSURE = 64, 7, 3, 0.8


def _running(lengths: Column, chunk: int = 256) -> Column:
    """Running sums of an array of int. Chunks are summed on their own first, as adding to a long array copies it."""
    none = F.array().cast("array<int>")

    def summed(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"] + x).alias("out"))
        return F.aggregate(part, start, step, lambda acc: acc["out"])

    def joined(parts: Column) -> Column:
        before = summed(F.transform(parts, lambda p: F.element_at(p, -1)))
        moved = lambda b: F.transform(parts, lambda p, k: F.transform(p, lambda x: x + F.coalesce(F.get(b, k - 1), F.lit(0))))
        return F.flatten(bound(before, moved))

    starts = F.sequence(F.lit(0), (F.size(lengths) - 1).cast("int"), F.lit(chunk))
    parts = F.transform(starts, lambda at: summed(F.slice(lengths, at + 1, F.lit(chunk))))
    return F.when(F.size(lengths) > 0, bound(parts, joined)).otherwise(none)


def _matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places: array of (start, end, value) in code points."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(values))
    ends = _running(F.zip_with(gaps, values, lambda g, v: F.length(g) + F.length(v)))

    def placed(end: Column, value: Column) -> Column:
        return F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"))

    return F.zip_with(ends, values, placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))

    def weighed(acc: Column, k: Column) -> Column:
        one = F.substring(digits, -k, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
        return acc + F.when(one > 9, one - 9).otherwise(one)

    return F.aggregate(places, F.lit(0), weighed) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(p.cast("int"), F.lit(999)) <= 255)
        return F.forall(F.split(F.regexp_replace(value, r"(^|\.)0+(?=[0-9])", "$1"), r"\."), small)
    if kind == "card":
        return F.length(_digits(value)).between(14, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All valid matches of all kinds: sorted array of (start, kind, end, value)."""
    parts = []
    for number, kind in enumerate(KINDS):
        found = F.filter(_matches(text, PATTERNS[kind]), lambda x: _valid(kind, x["value"]))
        found = F.transform(found, lambda x: F.struct(
            x["start"].alias("start"), F.lit(number).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))
        none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
        parts.append(F.when(text.rlike(HINTS[kind]), found).otherwise(none))
    return F.array_sort(F.concat(*parts))


def _shown(text: Column, base: Column) -> Column:
    """The entities of base: array of (entity, context), a hash of what surrounds it in the text."""

    def one(x: Column) -> Column:
        first = F.greatest(x["start"] - REACH, F.lit(0))
        before = F.substring(text, first + 1, x["start"] - first)
        after = F.substring(text, x["end"] + 1, F.lit(REACH))
        return F.struct(F.lower(x["value"]).alias("entity"), F.xxhash64(F.lower(before), F.lower(after)).alias("context"))

    return F.transform(base, one)


def _masked(text: Column, base: Column) -> Column:
    """The text with a space for every code point of an entity, so that places stay."""
    none = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        begin = F.greatest(acc["at"], x["start"])
        piece = F.concat(F.substring(text, acc["at"] + 1, begin - acc["at"]), F.repeat(F.lit(" "), x["end"] - begin))
        moved = F.struct(x["end"].alias("at"), F.array_append(acc["out"], piece).alias("out"))
        return F.when(x["end"] <= acc["at"], acc).otherwise(moved)

    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.aggregate(base, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(_words(text), F.lower))


def _used(words: Column, wanted: Column) -> Column:
    """The places in an array of words that hold a wanted term: array of (term, form, context), a hash of the words beside it."""

    def found(lowered: Column) -> Column:
        places = F.transform(lowered, lambda w, at: F.when(F.array_contains(wanted, w), at))

        def one(at: Column) -> Column:
            beside = F.slice(lowered, F.greatest(at + 1 - BESIDE, F.lit(1)), F.lit(2 * BESIDE + 1))
            return F.struct(F.get(lowered, at).alias("term"), F.get(words, at).alias("form"), F.xxhash64(beside).alias("context"))

        return F.transform(F.array_compact(places), one)

    return bound(F.transform(words, F.lower), found)


def _places(text: Column, form: Column) -> Column:
    """Where a word stands in the text, as it is written: array of spans."""
    gaps = F.split(text, F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), form, F.lit(r"(?![\p{L}\p{N}_])")), -1)
    inner = F.slice(gaps, F.lit(1), F.size(gaps) - 1)
    ends = _running(F.transform(inner, lambda gap: F.length(gap) + F.length(form)))
    return F.transform(ends, lambda end: F.struct((end - F.length(form)).alias("start"), F.lit(TERM).alias("kind"), end.alias("end")))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_CONTEXTS, disclosure: float = DISCLOSURE) -> DataFrame:
    """One row per row of docs: doc_id, key (two hashes of the text), base and terms, sorted arrays of (start, kind, end).

    Places are in code points, the end exclusive. A word is in terms wherever it stands, outside entities, in a text that
    holds an entity it reveals. It must be shown with the entity in `least` different surroundings, of the entity or of
    the word, so copies of a passage count once as evidence. Texts without personal data stay as they are. Null texts count
    as empty. Empty tables give empty results; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("doc_id"), _key(text).alias("key"), text.alias("text")).withColumn("base", base_spans(F.col("text")))
    bare = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    masked = F.when(F.size("base") > 0, _masked(F.col("text"), F.col("base")))
    rows = materialise(read.select("doc_id", "key", bare.alias("base"), _shown(F.col("text"), F.col("base")).alias("shown"), masked.alias("masked")), "personal")
    total = rows.count()

    # Equal texts are one from here on, with their number m.
    texts = rows.where("masked is not null").groupBy("key").agg(F.count("*").alias("m"), F.first("masked").alias("masked"), F.first("shown").alias("shown"))
    holding = materialise(texts, "holding")
    held = holding.select("key", "m", F.explode("shown").alias("x")).select("key", "m", "x.*")
    per = held.groupBy("entity", "key").agg((F.count("*") * F.first("m")).alias("n"), F.first("m").alias("m"))
    # A text or a place of the entity is at most one piece of evidence, so rarer entities cannot reach `least`.
    of_entity = per.groupBy("entity").agg(F.sum("m").alias("n_entity"), F.sum("n").alias("n")).where((F.col("n") >= least) & (F.col("n_entity") < total))
    entities = materialise(per.select("entity", "key").join(of_entity.drop("n"), "entity"), "entities")

    # A term and an entity share at most the entity's texts, so a term in more texts than this cannot tell so much of it.
    most = lambda n_entity: F.lit(float(max(1, total)) ** (1 - disclosure) * (1 + 1e-9)) * F.pow(n_entity, F.lit(disclosure))
    widest = entities.agg(F.max("n_entity")).first()[0] or 0
    of_term = docs.select(F.explode(_terms(text)).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    of_term = of_term.where(F.col("n_term") <= most(F.lit(widest)))
    largest = entities.groupBy("key").agg(F.max("n_entity").alias("largest"))
    terms = holding.join(largest, "key").select("key", "m", "largest", F.explode(_terms(F.col("masked"))).alias("term"))
    rare = materialise(terms.join(of_term, "term").where(F.col("n_term") <= most(F.col("largest"))).drop("largest"), "rare_terms")

    # Over whole texts; a hot entity's pairs are summed where they lie before they move.
    pairs = rare.join(entities, "key").where(F.col("n_term") <= most(F.col("n_entity")))
    together = pairs.groupBy("term", "entity").agg(F.sum("m").alias("both"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity"))
    share = F.log2(F.lit(float(total)) * F.col("both") / (F.col("n_term") * F.col("n_entity"))) / F.log2(F.lit(float(total)) / F.col("n_entity"))
    likely = materialise(together.where(share >= disclosure).select("term", "entity"), "likely")
    likely = materialise(pairs.select("key", "term", "entity").join(likely, ["term", "entity"], "left_semi"), "likely_pairs")

    wanted = likely.groupBy("key").agg(F.collect_set("term").alias("wanted"))
    words = holding.join(wanted, "key").select("key", F.col("masked"), "wanted", _words(F.col("masked")).alias("words"))
    used = materialise(words.select("key", F.explode(_used(F.col("words"), F.col("wanted"))).alias("w")).select("key", "w.*"), "likely_words")
    beside = used.groupBy("key", "term").agg(F.min("context").alias("context")).join(likely, ["key", "term"])
    around = likely.join(held.select("key", "entity", "context"), ["key", "entity"])
    evidence = beside.select("term", "entity", F.lit(0).alias("of"), "context").unionByName(around.select("term", "entity", F.lit(1).alias("of"), "context"))
    evidence = evidence.distinct().groupBy("term", "entity", "of").agg(F.count("*").alias("n"))
    telling = evidence.where(F.col("n") >= least).select("term", "entity").distinct()

    told = likely.join(telling, ["term", "entity"], "left_semi").select("key", "term").distinct()
    forms = used.join(told, ["key", "term"], "left_semi").groupBy("key").agg(F.collect_set("form").alias("forms"))
    places = F.array_sort(F.flatten(F.transform("forms", lambda form: _places(F.col("masked"), form))))
    added = forms.join(holding, "key").select("key", places.alias("terms"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return rows.drop("shown", "masked").join(added, "key", "left").withColumn("terms", F.coalesce("terms", none))


def _key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def _listed(places: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    one = lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(places, one), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term; see spans()."""
    found = spans(docs, id_col, text_col)
    count = lambda n: F.size(F.filter("base", lambda x: x["kind"] == n)).cast("long")
    return found.select(
        "doc_id",
        *[count(n).alias(f"n_{kind}") for n, kind in enumerate(KINDS)],
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "terms"))).alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text with entities replaced by their kind, telling names and numbers generalised, other words removed.

    Of spans that overlap the first is replaced and the others go with it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = spans(docs, id_col, text_col).select("key", F.array_sort(F.concat("base", "terms")).alias("places")).dropDuplicates(["key"])
    rows = docs.select(F.col(id_col).alias("doc_id"), _key(text).alias("key"), text.alias("text")).join(found, "key")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, x: Column) -> Column:
        old = F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"])
        term = F.when(old.rlike(r"^\p{N}+$"), "[NUMBER]").when(old.rlike(r"^\p{Lu}"), "[NAME]").otherwise("")
        new = F.when(x["kind"] < TERM, names[F.least(x["kind"], F.lit(TERM - 1))]).otherwise(term)
        gap = F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"])
        moved = F.struct(x["end"].alias("at"), F.concat(acc["out"], gap, new).alias("out"))
        return F.when(x["start"] < acc["at"], acc).otherwise(moved)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    return rows.select("doc_id", F.aggregate("places", start, step, rest).alias("text"))
