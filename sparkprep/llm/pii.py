"""Personal data: known forms, and the words that give them away, by information-theoretic sanitisation.

Known forms are e-mail and IP addresses, card and phone numbers. Each different one is a protected entity. A word is a
term of an entity if both occur in a document. How much a term reveals is its pointwise mutual information with the entity,

    PMI(t; e) = log(N * co(t, e) / (df(t) * n(e)))

with counts of documents over the whole corpus. Nothing can reveal more than the information of the entity,
log(N / n(e)); a term that reveals at least `disclosure` of it, and does so in `support` documents or more, is a span
too, wherever it stands in a document with the entity. (In one document alone every rare word seems to reveal
everything.) Sanitising puts a generalisation, the kind, in
the place of a span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.llm import spans as S
from sparkprep.llm.frames import cut
from sparkprep.llm.lines import asked_for

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
CARD_WHEN = r"[0-9](?:[\x20-]?[0-9]){13}"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: A text without any of these contains nothing of the known forms.
WHEN = {"email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": CARD_WHEN, "phone": r"\+[0-9]"}
ANY_FORM = "|".join(f"(?:{p})" for p in WHEN.values())
WORD = r"[^\x20\x09-\x0D]+"


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    own = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(own, F.lit(0), lambda s, x: s + x) % 10 == 0


def known_forms(text: Column) -> dict[str, Column]:
    """Arrays of (start, end, match, part) by kind."""
    only = lambda x: F.regexp_replace(x["match"], "[^0-9]", "")
    email = S.matches(text, EMAIL, WHEN["email"])
    ip = F.filter(S.matches(text, IP, WHEN["ip"]), lambda x: F.forall(F.split(x["match"], r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    card = F.filter(S.matches(text, CARD, WHEN["card"]), lambda x: F.length(only(x)).between(14, 19) & luhn(F.when(F.length(only(x)).between(14, 19), only(x)).otherwise(F.lit("1"))))
    phone = F.filter(S.matches(text, PHONE, WHEN["phone"]), lambda x: F.length(only(x)).between(10, 15))
    return dict(zip(KINDS, (email, ip, card, phone), strict=True))


def entities(text: Column) -> Column:
    """The different protected entities of a text, spelt in one way. No known form goes beyond a line."""
    def spelt(kind: str, found: Column) -> Column:
        one = F.lower if kind in ("email", "ip") else lambda m: F.regexp_replace(m, "[^0-9]", "")
        return F.transform(found, lambda x: F.concat(F.lit(f"{kind}:"), one(x["match"])))

    return F.array_distinct(F.concat(*(spelt(k, found) for k, found in known_forms(text).items())))


def disclosing(docs: DataFrame, disclosure: float, support: int) -> DataFrame:
    """(entity, word, co, df, n) of the terms above the threshold, from rows with a text."""
    texts = docs.select("text")
    rows = texts.where(F.col("text").rlike(ANY_FORM)).select("text", F.explode(entities(F.col("text"))).alias("entity")).withColumn("id", F.xxhash64("entity"))
    often = cut(rows.groupBy("id", "entity").agg(F.count("*").alias("n")).where(f"n >= {support}"))
    # a text has each entity and each word once, so counts of hashes add up before the shuffle
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: w.rlike(r"\p{L}") & ~w.contains("@")))
    pairs = rows.where(asked_for(often.select("id"))).select(F.col("id").alias("of"), F.explode(F.transform(words, lambda w: F.xxhash64(w))).alias("id"))
    terms = pairs.groupBy("of", "id").agg(F.count("*").alias("co")).where(f"co >= {support}")
    terms = cut(terms.join(often.withColumnRenamed("id", "of"), "of").select("entity", "n", "id", "co"))
    # a text has each word once, so counts add up before the shuffle
    asked = texts.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"))).alias("word")).withColumn("id", F.xxhash64("word")).where(asked_for(terms.select("id").distinct()))
    df = asked.groupBy("word", "id").agg(F.count("*").alias("df"))
    total = texts.agg(F.count("*").alias("total"))
    found = terms.join(df, "id").join(F.broadcast(total))
    return found.where(f"log(total * co / (df * n)) >= {disclosure} * log(total / n) AND n < total").select("entity", "word", "co", "df", "n")


def find_personal_data(docs: DataFrame, disclosure: float = 0.9, support: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, terms, sanitised) of each row.

    base has (start, order, end, kind) of the known forms, in order; terms those of disclosing words, anywhere in
    a text with their entity. Each kind's matches are leftmost and do not overlap; different kinds may. sanitised is the text
    with <KIND> in the place of the spans; where spans overlap, the one that starts first wins, then the kind in order.

    A null text is empty. Repeated rows count as often as they occur and get the same answer. Null keys are keys like
    others. Other columns are not read.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumns({"doc": F.xxhash64("doc_id"), "tag": F.xxhash64("text")})
    forms = known_forms(F.col("text"))
    known = docs.select("doc_id", "tag", "text", *(S.named(forms[k], k, i).alias(k) for i, k in enumerate(KINDS)))
    known = known.withColumn("base", F.array_sort(F.concat(*KINDS)))
    terms = disclosing(docs, disclosure, support).select("entity", "word")
    holds = docs.where(F.col("text").rlike(ANY_FORM)).select("tag", F.explode(entities(F.col("text"))).alias("entity")).distinct()
    words = holds.join(terms, "entity").groupBy("tag").agg(F.collect_set("word").alias("words"))
    out = known.join(words, "tag", "left")
    found = F.filter(S.matches(F.col("text"), WORD), lambda x: F.array_contains("words", F.lower(x["match"])))
    empty = "cast(array() AS array<struct<start: bigint, order: int, end: bigint, kind: string>>)"
    out = out.withColumn("terms", F.when(F.col("words").isNull(), F.expr(empty)).otherwise(S.named(found, "term", 4)))
    step = "IF(x.start < s.at, s, named_struct('at', x.end, 'done', concat(s.done, array(substring(text, cast(s.at + 1 AS int), cast(x.start - s.at AS int)), concat('<', upper(x.kind), '>')))))"
    clean = f"aggregate(array_sort(concat(base, terms)), named_struct('at', 0L, 'done', cast(array() AS array<string>)), (s, x) -> {step}, s -> concat(array_join(s.done, ''), substring(text, cast(s.at + 1 AS int))))"
    sizes = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *sizes, "base", "terms", F.expr(f"IF(size(base) + size(terms) = 0, text, {clean})").alias("sanitised"))
