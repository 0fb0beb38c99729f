"""Personal data: patterns with checks, and terms that disclose an entity by co-occurrence.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelmill.llm.common import materialise, text_of, whole_row

KINDS = ("email", "ip", "card", "phone", "term")
#: Equal to the plain patterns' leftmost matches, but linear: a match can start only where a run of its first class starts
#: or the last match ended, and possessive loops never back up.  Card runs with other than 14 to 19 digits are passed over.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
TERM = r"[\p{L}\p{M}\p{N}]++"
#: A term discloses an entity if it gives this share of the entity's information: PMI(term, entity) >= share * IC(entity).
DISCLOSURE = 0.8
#: Different texts in which term and entity must meet; one text is no evidence.
SUPPORT = 2
#: Bytes up to which a table of terms or texts' digests is broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32_000_000
#: Entries that one step of a running total takes.
BLOCK = 256


def let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, op) -> Column:
    """For each entry of an ``array<int>``, ``op`` over 0 and all entries before it.

    Blocks of entries are summed up first and then scanned from their own start,
    so that the work is nearly in proportion to the entries.
    """

    def scan(xs: Column, start: Column) -> Column:
        none = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, none, lambda a, x: F.struct(op(a["at"], x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")))["out"]

    def whole(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(v) - 1) / BLOCK)).cast("int"))
        part = lambda i: F.slice(v, i * BLOCK + 1, F.lit(BLOCK))
        starts = scan(F.transform(blocks, lambda i: F.aggregate(part(i), F.lit(0), op)), F.lit(0))
        return let(starts, lambda s: F.flatten(F.transform(blocks, lambda i: scan(part(i), F.get(s, i)))))

    return let(values, whole)


def _plus(a: Column, b: Column) -> Column:
    return a + b


def matches(text: Column, pattern: str) -> Column:
    """``array<struct<s int, e int, v string>>``: where the pattern matches, in code points, end exclusive."""

    def places(found: Column, gaps: Column) -> Column:
        sizes = F.zip_with(found, gaps, lambda m, g: F.coalesce(F.length(m), F.lit(0)) + F.length(g))
        start = lambda at, i: F.get(at, i) + F.length(F.get(gaps, i))
        return let(running(sizes, _plus), lambda at: F.transform(found, lambda m, i: F.struct(start(at, i).alias("s"), (start(at, i) + F.length(m)).alias("e"), m.alias("v"))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(F.split(text, pattern, -1), lambda gaps: places(found, gaps)))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    worth = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
            F.split(v, r"\."), lambda p: F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255
        )
    if kind == "card":
        return luhn(_digits(v))
    if kind == "phone":
        return F.length(_digits(v)).between(10, 15)
    return F.lit(True)


def _entity(kind: str, v: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.lower(v) if kind == "email" else _digits(v) if kind != "ip" else v)


NO_SPANS = "array<struct<s:int,k:int,e:int,entity:string>>"


def base_spans(text: Column) -> Column:
    """All base spans of a text, sorted by start and kind: ``array<struct<s, k, e, entity>>``."""
    hint = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][ -]?[0-9]"), "phone": text.contains("+")}
    parts = []
    for k, (kind, pattern) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=False)):
        # the functions are called at once, with this round's kind
        got = F.filter(matches(text, pattern), lambda m: _valid(kind, m["v"]))  # noqa: B023
        got = F.transform(got, lambda m: F.struct(m["s"].alias("s"), F.lit(k).alias("k"), m["e"].alias("e"), _entity(kind, m["v"]).alias("entity")))  # noqa: B023
        parts.append(F.when(hint[kind], got).otherwise(F.array().cast(NO_SPANS)))
    return F.array_sort(F.concat(*parts))


def gaps(text: Column, spans: Column) -> Column:
    """``array<struct<at int, part string>>``: the text before each of the sorted spans, and after the last one.

    ``at`` is the end of what the spans before cover; a span that touches or
    overlaps them has an empty part.  The text is cut for blocks of spans first.
    """

    def cut(s: Column, at: Column) -> Column:
        def block(j: Column) -> Column:
            own = F.slice(s, j * BLOCK + 1, F.lit(BLOCK))
            start = F.get(at, j * BLOCK)
            here = F.substring(text, start + 1, F.greatest(F.lit(0), F.element_at(own, -1)["s"] - start))

            def part(x: Column, lo: Column, here: Column) -> Column:
                return F.struct(lo.alias("at"), F.when(x["s"] > lo, F.substring(here, lo - start + 1, x["s"] - lo)).otherwise(F.lit("")).alias("part"))

            return let(here, lambda h: F.transform(own, lambda x, i: part(x, F.get(at, j * BLOCK + i), h)))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")), block))

    def all_(s: Column) -> Column:
        ends = F.transform(s, lambda x: x["e"])
        rest = let(F.array_max(ends), lambda e: F.array(F.struct(e.alias("at"), F.substring(text, e + 1, F.length(text)).alias("part"))))
        return let(running(ends, lambda a, b: F.greatest(a, b)), lambda at: F.concat(cut(s, at), rest))

    whole = F.array(F.struct(F.lit(0).alias("at"), text.alias("part")))
    return F.when(F.size(spans) == 0, whole).otherwise(let(spans, all_))


def _terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)


def terms_outside(text: Column, spans: Column) -> Column:
    """The different words of a text outside its spans, in lower case."""
    return F.array_distinct(F.flatten(F.transform(gaps(text, spans), lambda x: _terms(x["part"]))))


def mentions(text: Column, spans: Column, wanted: Column) -> Column:
    """``array<struct<s, k, e>>``: each place outside the spans where a word of ``wanted`` is."""

    def places(x: Column) -> Column:
        found = F.filter(matches(x["part"], TERM), lambda m: F.array_contains(wanted, F.lower(m["v"])))
        return F.transform(found, lambda m: F.struct((x["at"] + m["s"]).alias("s"), F.lit(4).alias("k"), (x["at"] + m["e"]).alias("e")))

    return F.flatten(F.transform(gaps(text, spans), places))


def _few(df: DataFrame) -> DataFrame:
    """A written table ``df`` of strings, arrays of strings and numbers, with a broadcast hint if it has at most BROADCAST_BYTES."""
    sizes = [F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 16) if k.startswith("array") else F.octet_length(F.col(c).cast("string")).cast("long") for c, k in df.dtypes]
    total = df.agg(F.sum(sum(sizes, F.lit(16 * len(sizes))))).first()[0]
    return F.broadcast(df) if (total or 0) <= BROADCAST_BYTES else df


def disclosing_terms(found: DataFrame, rows: DataFrame, share: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """``(th, terms)``: the terms of each text that give one of its entities away, from counts over all documents.

    ``found(th, spans)`` and ``rows(th, text)`` have a row per document.  Terms and
    entities meet in whole texts.  A term that gives an entity of n documents away
    is in at most N^(1-share) * n^share of the N documents, so more frequent ones
    are left out before pairs are made.
    """
    total = float(max(1, found.count()))
    held = found.where("size(spans) > 0").select("th", F.explode(F.array_distinct(F.transform("spans", lambda s: s["entity"]))).alias("entity"))
    held = held.groupBy("th", "entity").agg(F.count("*").alias("n"))
    entities = held.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("n_texts")).where((F.col("n_texts") >= support) & (F.col("n_entity") < total))
    most = F.lit(total ** (1 - share)) * F.pow(F.col("n_entity").cast("double"), F.lit(share)) * (1 + 1e-9)
    held = materialise(held.join(entities, "entity").select("th", "entity", "n_entity", most.alias("most")))
    texts = materialise(held.groupBy("th").agg(F.max("most").alias("most_of_text")))
    words = rows.join(_few(texts), "th").select("th", "most_of_text", F.explode(terms_outside(F.col("text"), base_spans(F.col("text")))).alias("term"))
    # a term is in at least as many documents as it is in those with an entity
    least = words.groupBy("term").agg(F.count("*").alias("n_near"), F.max("most_of_text").alias("most")).where((F.col("n_near") >= support) & (F.col("n_near") <= F.col("most")))
    least = materialise(least.select("term", "n_near"))
    words = words.join(_few(least), "term").where(F.col("n_near") <= F.col("most_of_text")).groupBy("th", "term", "n_near").agg(F.count("*").alias("n"))
    near = materialise(words.join(held, "th").where(F.col("n_near") <= F.col("most")).select("entity", "term", "th", "n", "n_entity", "n_near"))
    pairs = near.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("n_texts"), F.first("n_entity").alias("n_entity"), F.first("n_near").alias("n_near")).where(F.col("n_texts") >= support)
    known = F.ln(total / F.col("n_entity"))
    gain = lambda n_term: F.ln(F.col("n_both") * total / (F.col("n_entity") * n_term))
    pairs = materialise(pairs.where(gain(F.col("n_near")) >= share * known))
    counted = rows.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    counted = counted.join(_few(materialise(pairs.select("term").distinct())), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))
    pairs = pairs.join(counted, "term").where(gain(F.col("n_term")) >= share * known).select("entity", "term")
    return near.join(pairs, ["entity", "term"], "left_semi").groupBy("th").agg(F.collect_set("term").alias("terms"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


PLACES = "array<struct<s:int,k:int,e:int>>"


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))


def terms_by_text(docs: DataFrame, share: float = DISCLOSURE, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """Base spans ``(doc_id, th, spans)`` of all documents, and ``(th, terms)`` of texts with disclosing terms; both written."""
    rows = docs.select("doc_id", text_of(docs).alias("text"), F.md5(text_of(docs)).alias("th"))
    found = materialise(rows.select("doc_id", "th", base_spans(F.col("text")).alias("spans")))
    return found, materialise(disclosing_terms(found, rows.select("th", "text"), share, support))


def find_spans(docs: DataFrame, share: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """``docs(doc_id, text)`` to a row per document: doc_id, th (MD5 of the text), base and spans.

    ``base`` and ``spans`` are arrays of struct(s, k, e), sorted; spans adds term
    spans (k = 4): every mention, in documents that hold an entity, of a word whose
    co-occurrence with it over all documents discloses it.  Null text is empty, repeated rows each get
    a row, an empty table gives none, other columns are ignored.
    """
    found, terms = terms_by_text(docs, share, support)
    texts = docs.select(text_of(docs).alias("text"), F.md5(text_of(docs)).alias("th")).join(_few(terms), "th")
    terms = texts.select("th", mentions(F.col("text"), base_spans(F.col("text")), F.col("terms")).alias("terms")).groupBy("th").agg(F.first("terms").alias("terms"))
    out = found.select("doc_id", "th", _plain(F.col("spans")).alias("base")).join(terms, "th", "left")
    return out.select("doc_id", "th", "base", F.array_sort(F.concat("base", F.coalesce("terms", F.array().cast(PLACES)))).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """Counts by kind, digest of the base spans and all spans of each document."""
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return find_spans(docs).select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["k"] == 4)).cast("long").alias("n_term"),
    )


def replaced(text: Column, spans: Column) -> Column:
    """The text with each span (sorted; overlaps merge) replaced by its kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    put = lambda x, y: F.concat(x["part"], F.when(y["s"] >= x["at"], F.get(names, y["k"])).otherwise(F.lit("")))
    return let(spans, lambda s: let(gaps(text, s), lambda g: F.concat(F.array_join(F.zip_with(F.slice(g, 1, F.size(s)), s, put), ""), F.element_at(g, -1)["part"])))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with its personal data and disclosing terms replaced; an n_chars column follows the new text.

    Rows, repeated ones too, and other columns stay as they are, whatever their
    names; a null text stays null, an empty one empty; an empty table gives none.
    Base spans are found again in place, so texts are shuffled only if the table
    of their disclosing terms is too large to broadcast.
    """
    terms = terms_by_text(docs)[1].withColumnRenamed("th", "th0")
    rows = docs.select(whole_row(docs).alias("row"), text_of(docs).alias("text"), F.md5(text_of(docs)).alias("th"))
    rows = rows.join(_few(terms), F.col("th") == F.col("th0"), "left").select("row", "text", "terms", _plain(base_spans(F.col("text"))).alias("base"))
    more = F.when(F.col("terms").isNull(), F.array().cast(PLACES)).otherwise(mentions(F.col("text"), F.col("base"), F.col("terms")))
    rows = rows.select("row", "text", F.array_sort(F.concat("base", more)).alias("spans"))
    rows = rows.select("row", F.when(F.size("spans") > 0, replaced(F.col("text"), F.col("spans"))).alias("new"))
    out = []
    for name in docs.columns:
        old = F.col("row").getField(name)
        new = {"text": F.col("new"), "n_chars": F.length("new").cast(docs.schema[name].dataType)}.get(name)
        out.append((old if new is None else F.coalesce(new, old)).alias(name))
    return rows.select(*out)
