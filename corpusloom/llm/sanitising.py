"""Personal data: patterns for direct identifiers, and corpus statistics for the words that give them away.

Emails, IP addresses, card and phone numbers are found by pattern in every whole text. Each of them is an entity to
protect. A word that keeps occurring around an entity, and hardly elsewhere, reveals it even where the entity itself is
masked. How strongly is estimated from the corpus by pointwise mutual information, with documents as events:
``PMI(word; entity) = log2(n_both * N / (n_word * n_entity))``, where ``n_both`` counts documents in which the word
stands within ``REACH`` characters of the entity. A word is disclosed by the rules of information-theoretic
sanitisation where

* it tells more about the entity than its generalisation (its kind) does: ``PMI > IC(kind) = log2(N / n_kind)``;
* at most one bit of the entity stays hidden: ``IC(entity) - PMI <= 1``, that is ``n_word <= 2 * n_both``;
* it does so in at least ``CONTEXTS`` different contexts (neighbouring words), so that copies of a text prove nothing.

Such a word is a span of kind ``term`` wherever it stands near the entity. Sanitising generalises it to its beginning
(``Marg*``) if that beginning isn't disclosed by the same rules, else it is removed; identifiers become their kind.

Only column functions, joins and aggregates. Pairs are of an entity and the words next to it, never of all words of a
document; counts are combined map-side, so a word or an entity in a third of all documents is no hot group.

Defined cases: null text counts as empty; repeated rows are documents of their own; a null doc_id stays null; an empty
table gives no rows; other columns of the input are ignored. Positions are code points, ends exclusive. Texts of any
length are scanned whole, in time that grows with their length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import stored

#: Characters on each side of an entity in which words count, and different contexts that make a word sure.
REACH, CONTEXTS = 200, 3
#: A word may occur in so many documents for each one in which it stands near the entity: two are one bit.
HIDDEN = 2
#: Letters that the beginning of a word keeps as its generalisation.
BEGINNING = 4
#: Parts into which rows of one (entity, word) are dealt when they are looked up.
SALT = 16

# A match may start at the end of the one before or where no character of its first run precedes, which is where the
# leftmost match starts; so no run is tried twice.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
WORD = r"[\p{L}\p{M}]+"
#: Any identifier, as a mark between contexts.
ANY = rf"(?:{EMAIL})|(?:{PHONE})|(?:{IP})|(?:(?<![0-9])[0-9](?:[ -]?[0-9]){{12,}}+)"
BYTE = r"0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


#: Kinds in their order: pattern and which matches count.
KINDS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "email": (EMAIL, lambda h: F.lit(True)),
    "ip": (IP, lambda h: h.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")),
    "card": (CARD, lambda h: F.length(digits(h)).between(13, 19) & F.call_function("luhn_check", digits(h))),
    "phone": (PHONE, lambda h: F.length(digits(h)).between(9, 15)),
}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def before_each(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each element of a long array the merged elements in front of it. Runs of 128 are merged first, so that the
    work grows little faster than the array."""
    fold = lambda x: F.aggregate(x, zero, merge)
    run = 128

    def blocks(x: Column) -> Column:
        return F.sequence(F.lit(0), F.floor((F.size(x) - 1) / run).cast("int"))

    def cut(x: Column, b: Column) -> Column:
        return F.slice(x, b * run + 1, F.lit(run))

    def each(x: Column, sums: Column, b: Column) -> Column:
        def inside(some: Column, base: Column) -> Column:
            return F.transform(some, lambda _, j: merge(base, fold(F.slice(some, F.lit(1), j))))

        return let(fold(F.slice(sums, F.lit(1), b)), lambda base: let(cut(x, b), lambda some: inside(some, base)))

    def whole(x: Column) -> Column:
        return let(
            F.transform(blocks(x), lambda b: fold(cut(x, b))), lambda sums: F.flatten(F.transform(blocks(x), lambda b: each(x, sums, b)))
        )

    return let(values, whole)


HIT = "struct<hit:string,start:bigint,end:bigint,before:string,after:string>"
#: Matches and the texts behind them that can stand within ``REACH`` characters: an identifier has at least four.
STEPS = REACH // 4 + 2


def surroundings(zipped: Column) -> tuple[Column, Column]:
    """Arrays of the texts before and after each match, up to a character beyond ``REACH``: that one tells whether the
    word at the border goes on. Other matches in them are blanks, so words behind a match are in reach too."""
    blank = lambda x: F.repeat(F.lit(" "), F.coalesce(F.char_length(x["1"]), F.lit(0)))
    last = lambda x: F.substring(x, -REACH - 1, REACH + 1)
    first = lambda x: F.substring(x, 1, REACH + 1)
    ahead = F.transform(zipped, lambda x: last(F.concat(last(x["0"]), blank(x))))
    behind = F.transform(zipped, lambda x: first(F.concat(blank(x), first(F.coalesce(x["2"], F.lit(""))))))

    def before(ahead: Column) -> Column:
        near = lambda k: F.slice(ahead, F.greatest(k - STEPS, F.lit(0)) + 1, F.least(k, F.lit(STEPS)))
        return F.transform(zipped, lambda x, k: last(F.concat(F.array_join(near(k), ""), last(x["0"]))))

    def after(behind: Column) -> Column:
        near = lambda k: F.slice(behind, k + 2, F.lit(STEPS))
        return F.transform(zipped, lambda x, k: first(F.concat(first(F.coalesce(x["2"], F.lit(""))), F.array_join(near(k), ""))))

    return let(ahead, before), let(behind, after)


def matches(text: Column, pattern: str, around: bool = False) -> Column:
    """All matches with their places and, ``around`` given, the texts on both sides as ``surroundings`` has them."""

    def length(x: Column) -> Column:
        return F.coalesce(F.char_length(x), F.lit(0)).cast("bigint")

    def placed(zipped: Column) -> Column:
        sizes = F.transform(zipped, lambda x: length(x["0"]) + length(x["1"]))
        starts = before_each(sizes, F.lit(0).cast("bigint"), lambda a, b: a + b)
        sides = surroundings(zipped) if around else (F.transform(zipped, lambda _: F.lit("")),) * 2
        rows = F.arrays_zip(zipped.alias("x"), starts.alias("at"), sides[0].alias("before"), sides[1].alias("after"))
        return F.transform(F.filter(rows, lambda y: y["x"]["1"].isNotNull()), hit)

    def hit(y: Column) -> Column:
        x = y["x"]
        start = y["at"] + length(x["0"])
        return F.struct(
            x["1"].alias("hit"), start.alias("start"), (start + length(x["1"])).alias("end"),
            y["before"].alias("before"), y["after"].alias("after"),
        ).cast(HIT)

    def zipped(parts: Column) -> Column:
        return F.arrays_zip(parts.alias("0"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("1"), F.slice(parts, F.lit(2), F.lit(1 << 30)).alias("2"))

    found = let(F.split(text, pattern, -1), lambda parts: let(zipped(parts), placed))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{HIT}>"))


def base_spans(text: Column) -> Column:
    """Spans (kind, start, end) of all direct identifiers, by kind as listed, then start."""
    return F.concat(*[spans_of(text, name) for name in KINDS])


def spans_of(text: Column, kind: str) -> Column:
    pattern, counts = KINDS[kind]
    kept = F.filter(matches(text, pattern), lambda x: counts(x["hit"]))
    return F.transform(kept, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def kind_of(hit: Column) -> Column:
    """The kind of a match of ``ANY``, null where it doesn't count."""
    return (
        F.when(hit.contains("@"), "email")
        .when(hit.startswith("+"), F.when(KINDS["phone"][1](hit), F.lit("phone")))
        .when(hit.rlike(f"^{IP}$"), F.when(KINDS["ip"][1](hit), F.lit("ip")))
        .otherwise(F.when(KINDS["card"][1](hit), F.lit("card")))
    )


def entity_of(kind: Column, hit: Column) -> Column:
    """What a match stands for, however it is written."""
    return F.concat(kind, F.lit(":"), F.when(kind == "email", F.lower(hit)).when(kind == "ip", hit).otherwise(digits(hit)))


def beginning(word: Column) -> Column:
    return F.when(F.char_length(word) > BEGINNING, F.concat(F.substring(word, 1, BEGINNING), F.lit("*")))


def personal_data(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, base, terms, others): identifiers and revealing words of each document, and the columns ``keep``.

    ``base`` holds (kind, start, end), ``terms`` (start, end, shown), where ``shown`` is what generalising leaves.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    others = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), others.alias("others"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    marks = F.when(F.size("base") > 0, matches(F.col("text"), ANY, around=True)).otherwise(F.array().cast(f"array<{HIT}>"))
    marked = stored(rows.select(F.expr("uuid()").alias("rid"), "doc_id", "others", "base", marks.alias("marks")), "identifiers")
    near = words_near(marked)
    told = disclosed(marked, near, docs.select(text.alias("text")))
    salted = near.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALT)))
    every = told.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>")).alias("salt"))
    spans = salted.join(every, ["entity", "word", "salt"]).groupBy("rid", "start", "end").agg(F.min("shown").alias("shown"))
    terms = spans.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end", "shown"))).alias("terms"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,shown:string>>")
    return marked.join(terms, "rid", "left").select("doc_id", "base", F.coalesce("terms", none).alias("terms"), "others")


def words_near(marked: DataFrame) -> DataFrame:
    """(rid, kind, entity, word, form, start, end, context): words around each entity, and their places."""
    hits = marked.select("rid", F.explode("marks").alias("m")).withColumn("kind", kind_of(F.col("m.hit"))).filter("kind IS NOT NULL")
    sides = F.array(
        F.struct(F.col("m.before").alias("text"), (F.col("m.start") - F.char_length("m.before")).alias("at"), F.lit(False).alias("after")),
        F.struct(F.col("m.after").alias("text"), F.col("m.end").alias("at"), F.lit(True).alias("after")),
    )
    each = hits.select("rid", "kind", entity_of(F.col("kind"), F.col("m.hit")).alias("entity"), F.explode(sides).alias("s"))
    each = each.withColumn("w", matches(F.col("s.text"), WORD))
    size = F.size("w")
    shifted = lambda by: F.transform("w", lambda x, k: F.lower(F.get(F.col("w"), k + by)["hit"]))
    zipped = F.arrays_zip("w", shifted(-1).alias("left"), shifted(1).alias("right"))
    each = each.filter(size > 0).select("rid", "kind", "entity", "s", F.explode(zipped).alias("x"))
    # A word that takes the character beyond the reach is not within it, whether it is cut there or not.
    cut = (F.char_length("s.text") == REACH + 1) & F.when(F.col("s.after"), F.col("x.w.end") == REACH + 1).otherwise(F.col("x.w.start") == 0)
    word = F.lower("x.w.hit")
    return each.filter(~cut).select(
        "rid", "kind", "entity", word.alias("word"), (F.col("s.at") + F.col("x.w.start")).alias("start"),
        (F.col("s.at") + F.col("x.w.end")).alias("end"), F.xxhash64("s.after", "x.left", "x.right").alias("context"),
    )


def disclosed(marked: DataFrame, near: DataFrame, texts: DataFrame) -> DataFrame:
    """(entity, word, shown) of the words that reveal an entity; ``shown``: their beginning, or '' if that reveals it too."""
    forms = F.array_compact(F.array("word", beginning(F.col("word"))))
    uses = near.select("rid", "kind", "entity", F.explode(forms).alias("form"), "context")
    both = uses.groupBy("kind", "entity", "form").agg(F.count_distinct("rid").alias("n_both"), F.count_distinct("context").alias("contexts"))
    both = stored(both.filter(F.col("contexts") >= CONTEXTS), "near-entities")
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda w: F.lower(w)))
    words = texts.select(found.alias("words")).select(F.concat("words", F.array_distinct(F.array_compact(F.transform("words", beginning)))).alias("forms"))
    counts = words.select(F.explode("forms").alias("form")).groupBy("form").agg(F.count("*").alias("n_form"))
    # Only forms that stand near an entity are looked up.
    counts = counts.join(both.select("form").distinct(), "form", "left_semi")
    hits = marked.select("rid", F.explode("marks").alias("m")).withColumn("kind", kind_of(F.col("m.hit"))).filter("kind IS NOT NULL")
    hits = hits.select("rid", "kind", entity_of(F.col("kind"), F.col("m.hit")).alias("entity"))
    entities = hits.groupBy("kind", "entity").agg(F.count_distinct("rid").alias("n_entity"))
    kinds = hits.groupBy("kind").agg(F.count_distinct("rid").alias("n_kind"))
    told = both.join(counts, "form").join(entities, ["kind", "entity"]).join(F.broadcast(kinds), "kind")
    told = told.filter((F.col("n_both") * F.col("n_kind") > F.col("n_form") * F.col("n_entity")) & (F.col("n_form") <= HIDDEN * F.col("n_both")))
    told = stored(told.select("entity", "form"), "disclosed")
    ends = told.filter(F.col("form").endswith("*")).select("entity", F.col("form").alias("stem"), F.lit(True).alias("told"))
    words = told.filter(~F.col("form").endswith("*")).select("entity", F.col("form").alias("word"), beginning(F.col("form")).alias("stem"))
    shown = F.when(F.col("told").isNull(), F.coalesce("stem", F.lit(""))).otherwise("")
    return words.join(ends, ["entity", "stem"], "left").select("entity", "word", shown.alias("shown"))


def span_texts(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))


def digests(found: DataFrame) -> DataFrame:
    """Counts per kind, the checksum of the direct identifiers, and all spans as text."""
    count = lambda name: F.size(F.filter("base", lambda x: x["kind"] == name)).cast("bigint").alias(f"n_{name}")
    terms = F.transform("terms", lambda x: F.struct(F.lit("term").alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    base = span_texts(F.col("base"))
    return found.select(
        "doc_id", *[count(name) for name in KINDS], F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, span_texts(terms)), ",").alias("spans"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with identifiers replaced by their kind, revealing words by their beginning or by nothing."""
    found = personal_data(docs, keep=docs.columns)
    kind = "array<struct<start:bigint,end:bigint,shown:string>>"
    base = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.concat(F.lit("["), x["kind"], F.lit("]")).alias("shown")))
    text = F.col("others.text")
    last = F.struct(F.lit(1 << 30).cast("bigint").alias("start"), F.lit(1 << 30).cast("bigint").alias("end"), F.lit("").alias("shown"))
    spans = F.concat(F.array_sort(F.concat(base, "terms").cast(kind)), F.array(last))

    def part(y: Column) -> Column:
        x, at = y["x"], y["at"]
        between = F.substring(text, (at + 1).cast("int"), F.greatest(x["start"] - at, F.lit(0)).cast("int"))
        # Of overlapping spans the first is shown, and what it doesn't cover of the others goes with them.
        return F.concat(between, F.when(x["start"] >= at, x["shown"]).otherwise(""))

    def written(x: Column) -> Column:
        reached = before_each(F.transform(x, lambda s: s["end"]), F.lit(0).cast("bigint"), lambda a, b: F.greatest(a, b))
        return F.array_join(F.transform(F.arrays_zip(x.alias("x"), reached.alias("at")), part), "")

    clean = F.when(text.isNotNull(), let(spans, written))
    return found.select(*[(clean if c == "text" else F.col(f"others.`{c}`")).alias(c) for c in docs.columns])
