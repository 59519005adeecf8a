"""Personal data by patterns and by information-theoretic sanitisation, with SQL functions only.

Patterns find the protected entities: addresses of mail and networks, card and telephone
numbers. Other words may give an entity away because they hardly ever occur without it.
The corpus tells how strongly: over the words in a window around every mention, the
disclosure of entity c by term t is the share of the information content of c that t
carries, PMI(c; t) / IC(c), estimated from numbers of documents over the whole corpus. It
is 1 where t occurs with c alone. Terms of enough disclosure are removed wherever they
stand in any text, terms of somewhat less give way to the class of what they disclose:
beside a masked mention or far from it, a term still tells what was masked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

#: Kinds of spans in the order of the contract; the method adds the last.
KINDS = ("email", "ip", "card", "phone", "term")
#: Disclosure from which a term is removed, and from which it is generalised.
REMOVE, GENERALISE = 0.95, 0.85
#: Largest chance at which an entity and a term that are independent would meet as often.
CHANCE = 0.01
#: Code points of a window on either side of a mention, and letters of the shortest term.
WINDOW, SHORTEST = 64, 3

# Patterns find what the plain ones find, from the left and without overlap, but never
# step back inside a repetition: lookbehinds keep starts at the beginnings of runs (or at
# the end of the last match, \G) and possessive repetitions keep long texts linear.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Whole chains of digits with single separators; those of 12 to 19 digits only.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Running totals go over blocks of this many matches, and texts are cut into parts of so many
#: code points.
_BLOCK, _PART = 256, 4096


def _luhn(digits: Column) -> Column:
    """True if the digits pass the Luhn check."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i))
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when((n - i) % 2 == 1, doubled(i)).otherwise(value(i)))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    """Whether a match of the pattern is personal data."""
    if kind == "ip":
        part = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
        small = lambda p: F.coalesce(F.nullif(F.ltrim(p, F.lit("0")), F.lit("")), F.lit("0")).cast("int") <= 255
        parts = F.split(value, r"\.")
        return F.forall(parts, part) & F.forall(F.filter(parts, part), small)
    if kind == "card":
        digits = F.translate(value, " -", "")
        return F.length(digits).between(12, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _fence(df: DataFrame) -> DataFrame:
    """The same rows behind a generator: projections above are not merged into those below,
    so arrays that lambdas read many times are computed once."""
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def _running(steps: str, fold: str = "s + y") -> tuple[Column, Column]:
    """Totals of blocks of an integer array column, and its running totals given those of the
    blocks: a place costs a block and the number of blocks, not all places before it."""
    blocks = F.expr(f"transform(sequence(0, greatest(size({steps}) - 1, 0) div {_BLOCK}), b -> aggregate(slice({steps}, b * {_BLOCK} + 1, {_BLOCK}), 0, (s, y) -> {fold}))")
    running = F.expr(
        f"transform({steps}, (x, i) -> aggregate(concat(slice({steps}_blocks, 1, i div {_BLOCK}),"
        f" slice({steps}, (i div {_BLOCK}) * {_BLOCK} + 1, i % {_BLOCK} + 1)), 0, (s, y) -> {fold}))"
    )
    return blocks, running


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, digest, spans) with spans array<struct<start, end, kind, value, before, after>>.

    Spans are in code points, the end exclusive, ordered by start and kind; kind is the
    place in KINDS. before and after are the texts of up to WINDOW code points around a
    mention. digest is the SHA-256 of the text. A null text counts as empty.
    """
    kinds = list(PATTERNS)
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    df = df.select("*", F.sha2(F.col("text"), 256).alias("digest"), *[F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0)).alias(f"{k}_m") for k in kinds])
    df = _fence(df)
    none = F.array().cast("array<int>")
    gaps = lambda k: F.transform(F.split("text", PATTERNS[k], -1), F.length)
    df = df.select("doc_id", "text", "digest", *[f"{k}_m" for k in kinds], *[F.when(F.size(f"{k}_m") > 0, gaps(k)).otherwise(none).alias(f"{k}_g") for k in kinds])
    df = _fence(df)
    # A match starts after all gaps up to its own and all matches before it.
    step = lambda k: F.zip_with(
        F.slice(f"{k}_g", F.lit(1), F.size(f"{k}_m")),
        F.slice(F.concat(F.array(F.lit(0)), F.transform(f"{k}_m", F.length)), F.lit(1), F.size(f"{k}_m")),
        lambda a, b: a + b,
    )
    df = _fence(df.select("doc_id", "text", "digest", *[f"{k}_m" for k in kinds], *[step(k).alias(f"{k}_s") for k in kinds]))
    df = _fence(df.select("*", *[_running(f"{k}_s")[0].alias(f"{k}_s_blocks") for k in kinds]))
    df = _fence(df.select("doc_id", "text", "digest", *[f"{k}_m" for k in kinds], *[_running(f"{k}_s")[1].alias(f"{k}_at") for k in kinds]))

    def spans(place: int, k: str) -> Column:
        made = F.zip_with(f"{k}_at", f"{k}_m", lambda a, m: F.struct(a.cast("int").alias("start"), (a + F.length(m)).cast("int").alias("end"), F.lit(place).alias("kind"), m.alias("value")))
        return F.filter(made, lambda s: _valid(k, s["value"]))

    df = _fence(df.select("doc_id", "text", "digest", F.array_sort(F.concat(*[spans(i, k) for i, k in enumerate(kinds)])).alias("found")))
    window = lambda s: s.withField(
        "before", F.substring(F.col("text"), F.greatest(s["start"] + 1 - WINDOW, F.lit(1)), F.least(s["start"], F.lit(WINDOW)))
    ).withField("after", F.substring(F.col("text"), s["end"] + 1, F.lit(WINDOW)))
    return df.select("doc_id", "digest", F.transform("found", window).alias("spans"))


def _terms(mentions: DataFrame) -> DataFrame:
    """Rows (row, entity, context, term) of the whole words near mentions."""
    word = rf"\p{{L}}{{{SHORTEST},}}+"
    full = F.length("before") == WINDOW
    before = F.when(full, F.regexp_replace("before", r"^\p{L}++", "")).otherwise(F.col("before"))
    after = F.when(F.length("after") == WINDOW, F.regexp_replace("after", r"\p{L}++$", "")).otherwise(F.col("after"))
    words = F.concat(F.regexp_extract_all(before, F.lit(word), F.lit(0)), F.regexp_extract_all(after, F.lit(word), F.lit(0)))
    return mentions.select("row", "entity", "context", F.explode(F.array_distinct(F.transform(words, F.lower))).alias("term"))


def _words(text: Column) -> Column:
    """Distinct words of a text in lower case."""
    return F.array_distinct(F.split(F.lower(text), r"\P{L}+"))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (term, in_docs): documents (rows) of the whole corpus in which each word occurs."""
    words = _words(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.select(F.explode(words).alias("term")).where(F.length("term") >= SHORTEST).groupBy("term").agg(F.count(F.lit(1)).alias("in_docs"))


def disclosures(mentions: DataFrame, docs: DataFrame, text_col: str = "text", chance: float = CHANCE) -> DataFrame:
    """Rows (entity, term, disclosure) over terms that meet an entity more often than by chance.

    disclosure = log(n(c,t) N / (n(c) n(t))) / log(N / n(c)). All four are numbers of
    documents, every row of ``docs`` one: a document that meets entity and term in several
    windows counts once. Independent, c and t would meet in m = n(c) n(t) / N documents; k or
    more times at a chance of at most m^k / k!, where k is the number of different windows
    they met in, or of documents if that is less: copies of a window are no further evidence.
    Data that occurs once is judged too, by how rare its terms are.
    """
    n = float(max(docs.count(), 1))
    terms = store(_terms(mentions), "terms")
    number = F.count(F.lit(1))
    # Distinct first, then counted: a hot entity is pre-aggregated twice.
    pairs = terms.select("entity", "term", "row").distinct().groupBy("entity", "term").agg(number.alias("n_ct"))
    windows = terms.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(number.alias("contexts"))
    of_entity = mentions.select("entity", "row").distinct().groupBy("entity").agg(number.alias("n_c"))
    whole = pairs.join(windows, ["entity", "term"]).join(of_entity, "entity").join(document_frequencies(docs, text_col), "term")
    n_ct = F.least("n_ct", "in_docs")
    pmi = F.log(n_ct * F.lit(n) / (F.col("n_c") * F.col("in_docs")))
    content = F.log(F.lit(n) / F.col("n_c"))
    # Logarithms of m^k / k!; k! by ln k! >= k ln k - k, which is larger than the chance, and exact for 1.
    met = F.least("contexts", n_ct)
    of_k = F.when(met == 1, F.lit(0.0)).otherwise(met * F.log(met) - met)
    likely = met * F.log(F.col("n_c") * F.col("in_docs") / F.lit(n)) - of_k
    return whole.where((F.col("n_c") < n) & (likely <= F.lit(math.log(chance)))).select("entity", "term", (pmi / content).alias("disclosure"))


def _occurrences(docs: DataFrame, strong: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (of_doc, digest, added): every whole word of every text that is a term of ``strong``,
    one for each document and text.

    Words are joined first, without places; only texts with a term are cut into words again.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select("*", F.sha2("text", 256).alias("digest"))
    named = rows.select("doc_id", "digest", F.explode(_words(F.col("text"))).alias("term")).join(strong, "term")
    named = named.groupBy("doc_id", "digest").agg(F.map_from_entries(F.collect_set(F.struct("term", "action"))).alias("actions")).withColumnRenamed("doc_id", "of_doc").withColumnRenamed("digest", "of_digest")
    hit = rows.join(named, rows["doc_id"].eqNullSafe(named["of_doc"]) & (rows["digest"] == named["of_digest"])).select("of_doc", "digest", "actions", "text")
    word = rf"\p{{L}}{{{SHORTEST},}}+"
    df = _fence(hit.select("of_doc", "digest", "actions", F.regexp_extract_all("text", F.lit(word), F.lit(0)).alias("m"), F.transform(F.split("text", word, -1), F.length).alias("g")))
    step = F.zip_with(F.slice("g", F.lit(1), F.size("m")), F.slice(F.concat(F.array(F.lit(0)), F.transform("m", F.length)), F.lit(1), F.size("m")), lambda a, b: a + b)
    df = _fence(df.select("of_doc", "digest", "actions", "m", step.alias("w_s")))
    df = _fence(df.select("*", _running("w_s")[0].alias("w_s_blocks")))
    df = _fence(df.select("of_doc", "digest", "actions", "m", _running("w_s")[1].alias("at")))
    item = lambda a, m: F.struct(a.cast("int").alias("start"), (a + F.length(m)).cast("int").alias("end"), F.lit(KINDS.index("term")).alias("kind"), F.lower(m).alias("value"), F.try_element_at("actions", F.lower(m)).alias("action"))
    found = df.select("of_doc", "digest", F.filter(F.zip_with("at", "m", item), lambda t: t["action"].isNotNull()).alias("added"))
    return found.groupBy("of_doc", "digest").agg(F.first("added").alias("added"))  # repeated rows have equal ones


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: float = REMOVE, generalise: float = GENERALISE, chance: float = CHANCE) -> DataFrame:
    """Rows (doc_id, digest, spans): pattern spans and terms that disclose, one per row of ``docs``.

    spans is array<struct<start, end, kind, value, action>> by start and kind; action is
    ``mask``, ``remove`` or, for terms to generalise, the kind of what they disclose most. A
    term counts at every place of every text, by its strongest disclosure of any entity.
    Terms that touch a pattern span are part of it already. A null text is empty and has no
    spans; rows that repeat id and text have equal spans; an empty table gives no rows.
    """
    base = store(base_spans(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "spans")
    kinds = F.array(*[F.lit(k) for k in KINDS])
    mentions = base.select("row", F.inline("spans")).select(
        "row", F.concat_ws(":", F.element_at(kinds, F.col("kind") + 1), F.sha2(F.lower("value"), 256)).alias("entity"),
        F.xxhash64("before", "after").alias("context"), "before", "after",
    )
    strong = disclosures(mentions, docs, text_col, chance).where(F.col("disclosure") >= generalise)
    strong = strong.groupBy("term").agg(F.max(F.struct("disclosure", "entity")).alias("most"))
    action = F.when(F.col("most.disclosure") >= remove, F.lit("remove")).otherwise(F.substring_index("most.entity", ":", 1))
    added = _occurrences(docs, store(strong.select("term", action.alias("action")), "strong"), id_col, text_col)
    own = F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"], s["value"], F.lit("mask").alias("action")))
    joined = _attach(base.select("doc_id", "digest", own.alias("own")), added)
    free = F.filter(F.coalesce("added", F.array().cast("array<struct<start:int,end:int,kind:int,value:string,action:string>>")), lambda t: ~F.exists("own", lambda s: (t["start"] < s["end"]) & (s["start"] < t["end"])))
    return joined.select("doc_id", "digest", F.array_sort(F.concat("own", free)).alias("spans"))


def _attach(own: DataFrame, added: DataFrame) -> DataFrame:
    """Added spans of each row, by document and text."""
    same = own["doc_id"].eqNullSafe(added["of_doc"]) & (own["digest"] == added["digest"])
    return own.join(added, same, "left").select(own["doc_id"], own["digest"], "own", "added")


def span_text(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows and columns of ``docs`` with personal data masked in the text.

    Pattern spans become a mark of their kind, removed terms ``[REMOVED]`` and generalised
    ones a mark of the kind that they disclose, such as ``[EMAIL TERM]``. Spans that overlap
    are replaced once, by the first. Texts without spans, null ones included, stay as they
    are; repeated rows and rows without an id are masked alike; an empty table stays empty.
    """
    found = find_spans(docs, id_col, text_col, **options).where(F.size("spans") > 0)
    # One column of a name that no input has keeps clashing names apart.
    own = next(f"loom_{i}" for i in range(len(docs.columns) + 1) if f"loom_{i}" not in docs.columns)
    found = found.dropDuplicates(["doc_id", "digest"]).select(F.struct("doc_id", "digest", "spans").alias(own))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    same = docs[id_col].eqNullSafe(found[own]["doc_id"]) & (F.sha2(text, 256) == found[own]["digest"])
    joined = docs.join(found, same, "left")
    clean = joined.where(found[own].isNull()).select(*[docs[c] for c in docs.columns])
    return clean.unionByName(_masked(joined.where(found[own].isNotNull()), docs, text_col, found[own]["spans"]))


def _masked(hit: DataFrame, docs: DataFrame, text_col: str, spans: Column) -> DataFrame:
    """Rows of ``docs`` with their spans replaced, in time linear in the text.

    The text is cut into blocks once, and what stands between spans is put together from
    parts of blocks: a substring of the whole text would be sought from its first character.
    """
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    mark = lambda s: F.when(s["action"] == "mask", F.element_at(marks, s["kind"] + 1)).when(s["action"] == "remove", F.lit("[REMOVED]")).otherwise(F.concat(F.lit("["), F.upper(s["action"]), F.lit(" TERM]")))
    row = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")
    df = hit.select(
        row, F.length(docs[text_col]).alias("n"), F.regexp_extract_all(docs[text_col], F.lit(f"(?s).{{1,{_PART}}}"), F.lit(0)).alias("parts"),
        F.transform(spans, lambda s: s["start"]).alias("begin"), F.transform(spans, lambda s: s["end"]).alias("stop"), F.transform(spans, mark).alias("mark"),
    )
    df = _fence(df)
    df = _fence(df.select("*", _running("stop", "greatest(s, y)")[0].alias("stop_blocks")))
    # A span is replaced where all spans before it have ended; what they covered is gone.
    df = _fence(df.select("row", "n", "parts", "begin", "mark", F.concat(F.array(F.lit(0)), _running("stop", "greatest(s, y)")[1]).alias("done")))
    kept = "concat(filter(transform(begin, (b, i) -> struct(done[i] AS a, b AS b, mark[i] AS mark)), k -> k.a <= k.b), array(struct(done[size(begin)] AS a, n AS b, '' AS mark)))"
    part = f"transform(sequence(k.a div {_PART}, (k.b - 1) div {_PART}), p -> substring(parts[p], greatest(k.a - p * {_PART}, 0) + 1, least(k.b - p * {_PART}, {_PART}) - greatest(k.a - p * {_PART}, 0)))"
    clean = F.expr(f"array_join(transform({kept}, k -> concat(if(k.b > k.a, array_join({part}, ''), ''), k.mark)), '')")
    return df.select(*[clean.alias(c) if c == text_col else F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
