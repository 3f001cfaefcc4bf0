"""Personal data: pattern spans, and information-theoretic sanitisation of the terms that reveal them.

Patterns find e-mail addresses, IP addresses, card and phone numbers (base spans) and secrets: runs of at least SECRET_LENGTH
letters, digits and underscores that mix MIXED of both, such as keys and access tokens. Each distinct value is a protected entity
e. Every term t of the texts that hold it is a candidate; corpus counts over all documents say how strongly t reveals e:

    disclosure(t, e) = PMI(t; e) / IC(e) = log2(N df(t, e) / (df(t) df(e))) / log2(N / df(e))

which is 1 if t never occurs without e and 0 if they are independent. Terms of at least DISCLOSURE are spans of kind `term`
wherever they stand: from REMOVAL on they are removed, below it generalised, as other spans are. A pair needs EVIDENCE different
documents; documents whose terms have the same least values under two hashes count as one, as near copies mostly do, so that the
words that one document's copies share are not taken for names.

A pair (t, e) can reach the threshold only if df(t) <= df(e) (N / df(e))^(1 - DISCLOSURE); pairs are pruned by that before they
are counted, which loses none. Entities of exactly the same documents are counted once for all of them.

DataFrame functions only. Work on a text is linear in its length and its spans. Counts are aggregated before they are shuffled.
The regular expressions below match what the base patterns match, leftmost and without overlap, but never try a run of characters
from its middle, so long runs cost no quadratic time.

Null texts count as empty and have no spans. Rows that are equal in id and text share their spans. Spans that start together come
in the order of KINDS. A term that would overlap another span is covered by it. Extra columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import carried, cut, small_or_shuffled, text_of

KINDS = ("email", "ip", "card", "phone", "secret", "term")
BASE = KINDS[:4]
SECRET_LENGTH, MIXED = 20, 4
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": rf"(?<![A-Za-z0-9_])[A-Za-z0-9_]{{{SECRET_LENGTH},}}+",
}
OCTETS = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
TERM = r"\p{L}[\p{L}\p{M}]{2,}"
EVIDENCE, DISCLOSURE, REMOVAL = 3, 0.9, 0.98
#: Characters of a text that are taken together, so that a piece of it is found in two levels.
CHARACTERS = 1024

SPAN = "struct<start: int, rank: int, end: int, value: string>"
NO_SPANS = f"cast(array() as array<{SPAN}>)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: inside it the value is a variable, not an expression to be evaluated again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of ints (none below 0) all up to and with it combined, by + or greatest.

    Of n values some (2 n)^(1/3) are taken together, so that the steps inside a group and those over groups before it are few:
    O(n^(4/3)) in all.
    """
    to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    total = lambda part: F.aggregate(part, F.lit(0), combine)

    def along(v: Column, together: Column) -> Column:
        groups = F.transform(to(F.ceil(F.size(v) / together).cast("int")), lambda g: total(F.slice(v, g * together + 1, together)))
        before = lambda groups: F.transform(to(F.size(groups)), lambda g: total(F.slice(groups, F.lit(1), g)))
        within = lambda i: total(F.slice(v, i - i % together + 1, i % together + 1))
        return let(groups, lambda g: let(before(g), lambda b: F.transform(to(F.size(v)), lambda i: combine(F.get(b, (i / together).cast("int")), within(i)))))

    return let(values, lambda v: let(F.greatest(F.ceil(F.cbrt(2 * F.size(v))), F.lit(1)).cast("int"), lambda together: along(v, together)))


def spans_of(text: Column, pattern: str, kind: str, valid=None) -> Column:
    """array<struct<start, rank, end, value>> of the matches: a split's pieces and the matches give their places."""
    rank = KINDS.index(kind)

    def placed(found: Column) -> Column:
        steps = F.zip_with(F.split(text, pattern, -1), found, lambda p, m: F.coalesce(F.length(p), F.lit(0)) + F.coalesce(F.length(m), F.lit(0)))
        one = lambda m, end: F.struct((end - F.length(m)).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), m.alias("value"))
        return let(running(steps, lambda a, x: a + x), lambda ends: F.transform(found, lambda m, i: one(m, F.get(ends, i))))

    spans = F.filter(let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed), (lambda s: valid(s["value"])) if valid else (lambda s: F.lit(True)))
    return F.when(text.rlike(pattern), spans).otherwise(F.expr(NO_SPANS))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def pattern_spans(text: Column) -> dict[str, Column]:
    valid = {
        "email": None,
        "ip": lambda v: v.rlike(OCTETS),
        "card": lambda v: F.length(digits(v)).between(12, 19) & F.call_function("luhn_check", digits(v)),
        "phone": lambda v: F.length(digits(v)).between(9, 15),
        "secret": lambda v: (F.length(digits(v)) >= MIXED) & (F.length(F.regexp_replace(v, "[^A-Za-z]", "")) >= MIXED),
    }
    # Cheap tests first: most texts have neither.
    some = {"email": F.contains(text, F.lit("@")), "ip": text.rlike("[0-9]"), "card": text.rlike("[0-9]"), "phone": F.contains(text, F.lit("+")), "secret": text.rlike("[0-9]")}
    return {k: F.when(some[k], spans_of(text, p, k, valid[k])).otherwise(F.expr(NO_SPANS)) for k, p in PATTERNS.items()}


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["rank"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def key_of(ident: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.coalesce(ident.cast("string"), F.lit("null")), F.lit(":"), text)))


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def uncovered(spans: DataFrame) -> DataFrame:
    """Rows (key, start, rank, end, value) without the terms that overlap a span of another kind of their text."""
    term, at = F.col("rank") == len(KINDS) - 1, Window.partitionBy("key")
    reached = F.max(F.when(~term, F.col("end"))).over(at.orderBy("start").rangeBetween(Window.unboundedPreceding, 0))
    following = F.min(F.when(~term, F.col("start"))).over(at.orderBy("start").rangeBetween(0, Window.unboundedFollowing))
    marked = spans.withColumn("reached", reached).withColumn("following", following)
    return marked.where(~term | ((F.coalesce("reached", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("following") >= F.col("end"), F.lit(True)))).drop("reached", "following")


def personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, n_email, n_ip, n_card, n_phone, n_secret, n_term, base_spans, spans, key), one for each row of docs.

    base_spans and spans are arrays of struct<start, rank, end, value>; rank is the kind's place in KINDS, value is the text
    of a pattern's span and for terms `remove` or `generalise`.
    """
    plain = docs.select(F.col(f"`{id_column}`").alias("id"), text_of(text_column).alias("text")).withColumn("key", key_of(F.col("id"), F.col("text")))
    found = plain.select("id", "key", "text", *[c.alias(k) for k, c in pattern_spans(F.col("text")).items()])
    found = found.withColumn("found", F.array_sort(F.concat(*PATTERNS))).withColumn("base", F.array_sort(F.concat(*BASE)))
    # What an address is made of is no term beside it.
    beside = F.when(F.size("found") > 0, terms_of(F.regexp_replace("text", PATTERNS["email"], " "))).alias("terms")
    found = cut(found.select("id", "key", *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS], "base", "found", beside), "base")

    flagged = disclosing_terms(plain, found)["documents"]  # (key, term, action)
    words = plain.join(small_or_shuffled(cut(flagged.select("key").distinct(), "keys")), "key").dropDuplicates(["key"])
    words = words.select("key", F.explode(spans_of(F.col("text"), TERM, "term")).alias("s")).select("key", "s.*").withColumn("term", F.lower("value"))
    terms = words.join(flagged, ["key", "term"]).select("key", "start", "rank", "end", F.col("action").alias("value"))
    others = found.join(flagged.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]).select("key", F.explode("found").alias("s")).select("key", "s.*")
    terms = uncovered(terms.unionByName(others)).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "value"))).alias("all"))
    out = found.join(terms, "key", "left").withColumn("spans", F.coalesce("all", "found"))
    n_term = F.size(F.filter("spans", lambda s: s["rank"] == len(KINDS) - 1)).cast("long").alias("n_term")
    return out.select(F.col("id").alias(id_column), *[f"n_{k}" for k in PATTERNS], n_term, F.col("base").alias("base_spans"), "spans", "key")


def disclosing_terms(plain: DataFrame, found: DataFrame) -> dict:
    """Which terms of which documents exceed the disclosure threshold."""
    n = float(found.count())
    reach = lambda df_e: F.pow(F.lit(n) / df_e, F.lit(1 - DISCLOSURE)) * (1 + 1e-9)
    entity = lambda s: F.concat_ws(":", s["rank"].cast("string"), F.lower(s["value"]))
    some = found.where(F.size("found") > 0).withColumn("place", F.monotonically_increasing_id())
    some = cut(some.select("place", "key", "terms", F.array_distinct(F.transform("found", entity)).alias("entities")), "some")
    # Written before it is joined, as one entity may be in any share of the documents.
    mentions = cut(some.select("place", "key", F.explode("entities").alias("entity")), "mentions")
    entities = cut(mentions.groupBy("entity").agg(F.count("*").alias("df_e"), F.sum(F.xxhash64("place").cast("decimal(38,0)")).alias("same")), "entities")
    by_doc = cut(mentions.join(small_or_shuffled(entities), "entity").groupBy("place").agg(F.collect_set(F.struct("df_e", "same")).alias("classes")), "classes")
    least = lambda more: F.array_min(F.transform("terms", lambda t: F.xxhash64(F.concat(t, F.lit(more)))))
    texts = some.join(small_or_shuffled(by_doc), "place").select("classes", "terms", F.struct(least("").alias("a"), least("#").alias("b")).alias("sketch"))
    in_corpus = plain.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df_t"))
    vocabulary = cut(in_corpus.where(F.col("df_t") >= EVIDENCE), "vocabulary")
    in_texts = texts.select("sketch", "classes", F.explode("terms").alias("term")).join(small_or_shuffled(vocabulary), "term")
    possible = F.filter("classes", lambda c: (c["df_e"] >= EVIDENCE) & (F.col("df_t") <= c["df_e"] * reach(c["df_e"])))
    pairs = in_texts.select("term", "df_t", "sketch", F.explode(possible).alias("class"))
    joint = pairs.groupBy("class", "term", "sketch").agg(F.count("*").alias("rows"), F.first("df_t").alias("df_t"))
    joint = joint.groupBy("class", "term").agg(F.sum("rows").alias("df_te"), F.count("*").alias("evidence"), F.first("df_t").alias("df_t"))
    scored = joint.where(F.col("evidence") >= EVIDENCE).select("term", F.col("class.df_e").alias("df_e"), "df_te", "df_t")
    information = F.log2(F.lit(n) / F.col("df_e"))
    scored = scored.withColumn("disclosure", F.log2(F.lit(n) * F.col("df_te") / F.col("df_t") / F.col("df_e")) / F.when(information > 0, information))
    strong = cut(scored.where(F.col("disclosure") >= DISCLOSURE).groupBy("term").agg(F.when(F.max("disclosure") >= REMOVAL, "remove").otherwise("generalise").alias("action")), "strong")
    hits = plain.select("key", F.explode(terms_of(F.col("text"))).alias("term")).join(small_or_shuffled(strong), "term")
    return {"documents": cut(hits.select("key", "term", "action").distinct(), "flagged"), "scored": scored}


def sanitised(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with their text column sanitised: pattern spans become [EMAIL] and so on, terms [TERM] or nothing.

    Of spans that overlap, the first is replaced and the others' characters go with it. Texts without spans stay as they are, null too.
    """
    spans = personal_data(docs, id_column, text_column).where(F.size("spans") > 0).groupBy("key").agg(F.first("spans").alias("spans"))
    rows = carried(docs).withColumn("text", F.coalesce(F.col(f"row.`{text_column}`").cast("string"), F.lit("")))
    rows = rows.withColumn("key", key_of(F.col(f"row.`{id_column}`"), F.col("text"))).join(spans, "key", "left")
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    label = lambda s: F.when((s["rank"] == len(KINDS) - 1) & (s["value"] == "remove"), F.lit("")).otherwise(F.element_at(labels, s["rank"] + 1))
    chunk = lambda at: (at / CHARACTERS).cast("int")

    def between(chunks: Column, a: Column, b: Column) -> Column:
        """The characters from a up to b: of one chunk, or of a first, whole ones and a last."""
        ends = lambda i, a, n: F.coalesce(F.substring(F.get(chunks, i), a % CHARACTERS + 1, n), F.lit(""))
        far = F.concat(ends(chunk(a), a, F.lit(CHARACTERS)), F.array_join(F.slice(chunks, chunk(a) + 2, F.greatest(chunk(b) - chunk(a) - 1, F.lit(0))), ""), ends(chunk(b), F.lit(0), b % CHARACTERS))
        return F.when(chunk(a) == chunk(b), ends(chunk(a), a, b - a)).otherwise(far)

    def replaced(chunks: Column) -> Column:
        def with_ends(ends: Column) -> Column:
            def one(s: Column, i: Column) -> Column:
                before = F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
                return F.when(s["start"] >= before, F.concat(between(chunks, before, s["start"]), label(s))).otherwise(F.lit(""))

            return F.concat(F.array_join(F.transform("spans", one), ""), between(chunks, F.element_at(ends, -1), F.length("text")))

        return let(running(F.transform("spans", lambda s: s["end"]), lambda a, x: F.greatest(a, x)), with_ends)

    parts = let(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHARACTERS}}}"), F.lit(0)), replaced)
    clean = F.when(F.col("spans").isNull(), F.col(f"row.`{text_column}`")).otherwise(parts)
    return rows.select(F.col("row").withField(f"`{text_column}`", clean).alias("row")).select("row.*")
