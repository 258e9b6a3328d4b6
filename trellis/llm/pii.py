"""Personal data and what gives it away, with DataFrame functions only.

Base spans come from four fixed patterns. Strings that hold too much information by themselves (a run of 20 code characters
or more with letters and digits whose length times the entropy of its characters is at least `bits`) are spans of kind
`secret`: keys and tokens. On top, information-theoretic sanitisation asks of each term how strongly it reveals an entity (one
particular address, number, secret, ...), an aspect of it that `[KIND]` would hide (the domain of an address, the network of
an IP, the first digits of a number), or its kind: that there is one. So an entity of a single document is judged by
what it shares with others. Terms are words of the `reach` characters on either side of a mention. With numbers of documents
in the whole corpus,

    IC(e) = log2(N / df(e)),   PMI(e, t) = log2(N * df(e, t) / (df(e) * df(t))),

and t discloses e when PMI(e, t) >= disclosure * IC(e): reading t then gives nearly all the information that e holds. A
pair needs two different texts and two different contexts (words next to t), so that copies of one text are no evidence;
with fewer than `support` documents, the words on both sides of t must differ, which an edit in a near copy seldom does.
What a single text alone has, in no aspect shared, has no co-occurrence to count.
Disclosing terms become spans of kind `term` in the documents that mention e; in `sanitised`, entities are generalised to
their kind and such terms removed.

Scale: the patterns never backtrack over a run more than 14 characters long, and places of n hits are running sums by
doubling, so time is linear in a text but for a factor of log2(n). (`sanitised`, which the query does not ask for, cuts the
text at each span, which costs length times spans.) A mention has a bounded number of terms, so co-occurrences grow with the
mentions; they are counted by partial aggregates. Only documents with a hit are written and joined; terms are broadcast only
if a count shows them within `broadcast_rows`. Nothing gathers the documents of an entity or a term.

Edge cases: null text is empty. Null and repeated doc_ids, repeated rows and an empty table pass through row by row.
Columns named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import lean, running, stored, text_of

#: Kinds in the order that breaks ties, with their patterns. `\\G|(?<!..)` only says where a leftmost match can start, and
#: possessive repeats only that nothing need be given back: both save backtracking and change no match. Of cards only runs
#: of 14 digits or more are asked for: a run is a match as a whole, and shorter ones are dropped anyway.
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
_NEEDS = {"email": lambda t: F.contains(t, F.lit("@")), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(PATTERNS["card"]), "phone": lambda t: F.contains(t, F.lit("+"))}
_NONE = "array<struct<start:bigint,k:int,end:bigint,kind:string>>"
#: Kinds that the method adds, after those of the patterns.
SECRET, TERM = len(PATTERNS), len(PATTERNS) + 1
_SECRET = r"(?<![A-Za-z0-9_+=-])[A-Za-z0-9_+=-]{20,}+(?!\.?[A-Za-z0-9._%+-]*@)"
#: A word is a longest run of letters of the text in lower case; shorter ones than three letters are no terms.
_WORD = r"\p{L}+"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    padded = F.lpad(d, 19, "0")
    total = F.lit(0)
    for i in range(1, 20):
        x = F.substr(padded, F.lit(i), F.lit(1)).cast("int")
        total = total + (F.when(x > 4, 2 * x - 9).otherwise(2 * x) if (19 - i) % 2 else x)
    return total % 10 == 0


_HOLDS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
    "card": lambda v: F.length(_digits(v)).between(14, 19) & F.when(F.length(_digits(v)).between(14, 19), _luhn(_digits(v))).otherwise(False),
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
}


def _placed(pieces: Column, hits: Column) -> Column:
    """Spans of hits, from the hits and what lies before and between them, with up to `_REACH` characters on either side."""
    steps = F.transform(hits, lambda h, i: (F.length(F.get(pieces, i)) + F.length(h)).cast("long"))
    ends = F.zip_with(running(steps), hits, lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("value")))
    return F.transform(ends, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), _near(F.get(pieces, i), -1).alias("before"), _near(F.get(pieces, i + 1), 1).alias("after")))


_REACH = 80


def _near(piece: Column, side: int) -> Column:
    """The end (side -1) or beginning of a piece, without a word that the reach cuts."""
    some = F.right(piece, F.lit(_REACH)) if side < 0 else F.left(piece, F.lit(_REACH))
    return F.when(F.length(piece) > _REACH, F.regexp_replace(some, r"^\p{L}+" if side < 0 else r"\p{L}+$", "")).otherwise(piece)


def information(v: Column) -> Column:
    """Bits in a string: its length times the entropy of its characters."""
    n = F.length(v).cast("double")
    number = lambda c: n - F.length(F.replace(v, c, F.lit("")))
    return F.aggregate(F.array_distinct(F.split(v, "")), F.lit(0.0), lambda s, c: s + number(c) * F.log2(n / number(c)))


def base_spans(df: DataFrame, text: str = "_text", bits: float = 64.0) -> DataFrame:
    """df with `_base`: array of (start, k, end, kind, value, before, after), k the kind's place; and `_secret` alike."""
    kinds = {**PATTERNS, "secret": _SECRET}
    mixed = lambda v: (F.length(F.regexp_replace(v, "[^0-9]", "")) >= 3) & (F.length(F.regexp_replace(v, "[^A-Za-z]", "")) >= 3)
    holds = {**_HOLDS, "secret": lambda v: F.when(mixed(v), information(v) >= bits).otherwise(False)}
    needs = {**_NEEDS, "secret": lambda t: t.rlike(r"[A-Za-z0-9_+=-]{20}")}
    for kind, pattern in kinds.items():
        df = df.withColumn(f"_h_{kind}", F.when(needs[kind](F.col(text)), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
        df = df.withColumn(f"_p_{kind}", F.when(F.size(f"_h_{kind}") > 0, F.split(text, pattern, -1)))

    def spans(k: int, kind: str) -> Column:
        held = F.filter(_placed(F.col(f"_p_{kind}"), F.col(f"_h_{kind}")), lambda x: holds[kind](x["value"]))
        full = F.transform(held, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end"), F.lit(kind).alias("kind"), *(x[c].alias(c) for c in ("value", "before", "after"))))
        return F.when(F.size(f"_h_{kind}") > 0, full).otherwise(F.array().cast("array<struct<start:bigint,k:int,end:bigint,kind:string,value:string,before:string,after:string>>"))

    df = df.withColumn("_base", F.sort_array(F.concat(*(spans(k, kind) for k, kind in enumerate(PATTERNS))))).withColumn("_secret", spans(SECRET, "secret"))
    return df.drop(*(f"_{a}_{kind}" for kind in kinds for a in "hp"))


def entity(span: Column) -> Column:
    """What makes two mentions the same entity: the kind, and the address in lower case or the digits."""
    return F.concat(span["kind"], F.lit(":"), F.when(span["kind"] == "email", F.lower(span["value"])).when(span["kind"] == "ip", span["value"]).otherwise(_digits(span["value"])))


def aspects(span: Column) -> Column:
    """Hashes of the entity, of the coarser things that it tells, and of its kind."""
    lower, digits = F.lower(span["value"]), _digits(span["value"])
    domain = F.substring_index(lower, "@", -1)
    told = (
        F.when(span["kind"] == "email", F.array(domain, F.substring_index(domain, ".", -2)))
        .when(span["kind"] == "ip", F.array(*(F.substring_index(span["value"], ".", k) for k in (3, 2, 1))))
        .when(span["kind"] == "card", F.array(F.substring(digits, 1, 6), F.substring(digits, 1, 2)))
        .when(span["kind"] == "phone", F.array(F.substr(digits, F.lit(1), F.length(digits) - 4), F.substring(digits, 1, 4)))
        .otherwise(F.array().cast("array<string>"))
    )
    own = F.when(span["kind"] == "secret", F.concat(F.lit("secret:"), span["value"])).otherwise(entity(span))
    return F.array_distinct(F.concat(F.array(F.xxhash64(own), F.xxhash64(F.lit("kind"), span["kind"])), F.transform(told, lambda x: F.xxhash64(F.lit("part"), span["kind"], x))))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def _distinct_words(df: DataFrame, text: Column, *names: str) -> DataFrame:
    """(names, t): the hash of each different word of three letters or more of a row's text."""
    words = df.select(*names, F.explode(F.array_distinct(F.split(F.lower(text), r"\P{L}+"))).alias("w"))
    return words.where(F.length("w") >= 3).select(*names, F.xxhash64("w").alias("t"))


def disclosing(found: DataFrame, texts: DataFrame, n: int, *, disclosure: float, support: int, broadcast_rows: int) -> DataFrame:
    """(e, t): entities' aspects and hashes of the terms that disclose them.

    found: (d, x, mentions), different documents with a hash of the text and their spans; texts: (text) of all n documents.
    """
    mentions = found.select("d", "x", F.explode("mentions").alias("m")).select("d", "x", aspects(F.col("m")).alias("entities"), F.concat(_words(F.col("m.before")), F.array(F.lit("")), _words(F.col("m.after"))).alias("w"))
    shared = stored(mentions.select("d", F.explode("entities").alias("e")).distinct().groupBy("e").agg(F.count("*").alias("df_e")).where("df_e > 1"), "pii-entities")
    side = lambda k: F.xxhash64(F.get("w", F.col("i") + k))
    words = mentions.select("d", "x", "entities", "w", F.posexplode("w").alias("i", "y")).where(F.length("y") >= 3)
    words = words.select("d", "x", F.explode("entities").alias("e"), F.xxhash64("y").alias("t"), side(-1).alias("l"), side(1).alias("r"))
    each = words.groupBy("e", "t", "d", "x").agg(*(f(c).alias(f"{c}{k}") for c in "lr" for k, f in enumerate((F.min, F.max))))
    pairs = each.groupBy("e", "t").agg(F.count("*").alias("both"), *(f(f"{c}{k}").alias(f"{c}{k}") for c in "lr" for k, f in enumerate((F.min, F.max))), F.min("x").alias("x0"), F.max("x").alias("x1"))
    left, right = F.col("l0") != F.col("l1"), F.col("r0") != F.col("r1")
    pairs = pairs.where((F.col("both") > 1) & (F.col("x0") != F.col("x1")) & F.when(F.col("both") >= support, left | right).otherwise(left & right))
    pairs = stored(pairs.select("e", "t", "both").join(shared, "e"), "pii-pairs")
    wanted = stored(pairs.select("t").distinct(), "pii-wanted")
    spread = _distinct_words(texts, F.col("text")).join(lean(wanted, broadcast_rows), "t", "left_semi").groupBy("t").agg(F.count("*").alias("df_t"))
    ic = F.log2(F.lit(float(n)) / F.col("df_e"))
    pmi = F.log2(F.lit(float(n)) * F.col("both") / (F.col("df_e") * F.col("df_t")))
    return pairs.join(spread, "t").where((ic > 0) & (pmi >= disclosure * ic)).select("e", "t")


def sanitise(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", disclosure: float = 0.9, support: int = 3, bits: float = 64.0, broadcast_rows: int = 500_000) -> DataFrame:
    """docs with `base` and `spans` (arrays of (start, k, end, kind), sorted) and `sanitised` added."""
    names = [c for c in docs.columns if c not in ("base", "spans", "sanitised")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), text_of(text).alias("_text"), F.col(doc).cast("string").alias("_id"))
    hit = base_spans(rows, bits=bits)
    has_hit = (F.size("_base") > 0) | (F.size("_secret") > 0)
    # not filters: those would be moved below, and work the spans out anew for each of their elements
    only = lambda which, *names: hit.select(F.explode(F.when(which, F.array(F.struct(*names)))).alias("_kept")).select("_kept.*")
    some = stored(only(has_hit, "_row", "_id", "_base", "_secret"), "pii-hits")
    body = text_of(f"_row.{text}")
    some = some.withColumn("_d", F.xxhash64("_id", body))
    # a document once, if rows repeat it
    found = some.select(F.col("_d").alias("d"), F.xxhash64(body).alias("x"), F.concat("_base", "_secret").alias("mentions")).dropDuplicates(["d"])
    found = stored(found, "pii-found")
    told = stored(disclosing(found, rows.select(F.col("_text").alias("text")), rows.count(), disclosure=disclosure, support=support, broadcast_rows=broadcast_rows), "pii-terms")
    # the terms of each document: its words among all terms, then those of its own entities
    own = some.select("_d", body.alias("text")).dropDuplicates(["_d"])
    held = _distinct_words(own, F.col("text"), "_d").join(lean(told.select("t").distinct(), broadcast_rows), "t", "left_semi")
    entities = found.select(F.col("d").alias("_d"), F.explode(F.array_distinct(F.flatten(F.transform("mentions", aspects)))).alias("e")).join(lean(told.select("e").distinct(), broadcast_rows), "e", "left_semi")
    terms = held.join(entities, "_d").join(told, ["e", "t"], "left_semi").groupBy("_d").agg(F.collect_set("t").alias("_terms"))
    some = some.join(terms, "_d", "left").withColumn("_text", body)
    has = F.size("_terms") > 0
    some = some.withColumn("_w", F.when(has, F.regexp_extract_all("_text", F.lit(_WORD), F.lit(0)))).withColumn("_p", F.when(has, F.split("_text", _WORD, -1)))
    clear = lambda x: ~F.exists(F.concat("_base", "_secret"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    steps = F.transform("_w", lambda w, i: (F.length(F.get("_p", i)) + F.length(w)).cast("long"))
    placed = F.zip_with(running(steps), F.col("_w"), lambda e, w: F.struct((e - F.length(w)).alias("start"), e.alias("end"), w.alias("value")))
    kept = F.filter(placed, lambda x: F.array_contains(F.col("_terms"), F.xxhash64(F.lower(x["value"]))) & clear(x))
    short = lambda spans: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end"), x["kind"].alias("kind")))
    more = F.when(has, F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(TERM).alias("k"), x["end"].alias("end"), F.lit("term").alias("kind")))).otherwise(F.array().cast(_NONE))
    some = some.select("_row", "_text", short("_base").alias("base"), F.sort_array(F.concat(short("_base"), short("_secret"), more)).alias("spans"))
    redacted = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(x["start"] >= s["at"], F.concat(s["out"], F.array(F.substr("_text", (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.when(x["kind"] == "term", "").otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))))).otherwise(s["out"]).alias("out"),
        ),
        lambda s: F.concat(F.array_join(s["out"], ""), F.substr("_text", (s["at"] + 1).cast("int"))),
    )
    some = some.select("_row.*", "base", "spans", redacted.alias("sanitised"))
    none = F.array().cast(_NONE)
    rest = only(~has_hit, "_row", "_text").select("_row.*", none.alias("base"), none.alias("spans"), F.col("_text").alias("sanitised"))
    return some.unionByName(rest)


def written(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
