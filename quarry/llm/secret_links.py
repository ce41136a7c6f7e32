"""Secret scans with multipart credential linking; DataFrame and SQL functions only.

Three base kinds (assign, access, hex) are found in every text by regular expressions, leftmost
and non-overlapping for each kind, inside the row and without a shuffle. Weak kinds are looked for
in what base spans leave: the short forms of the base kinds (an assigned value of 3 to 7
characters, an access identifier of 8 to 15, hex digits of 16 to 31 with letters and figures),
user names and mail addresses (ident), opaque strings, and addresses of services (endpoint). They
are candidates only: one is reported when a part that complements it, base or weak, lies within
``SCOPE`` code points of it. A secret complements identifiers and endpoints; an identifier or an
endpoint complements secrets. Base parts are linked in the same way and stay in any case.

The interval join of parts runs as a sweep: the parts of a document are ordered by start, and
running bounds of each role give the nearest part on either side, so that no pairs are made. Only
parts of documents with two or more are shuffled; the regular expressions run once.

Defined results: a null text is empty and holds nothing; offsets count code points, ends are
exclusive; parts with equal starts are ordered by kind; of two complements equally near the one
before counts; repeated rows are told apart by their place in the stored table and each give a
row; an empty table gives no rows; texts are scanned whole at any length; columns of the input
keep their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import fresh, let, stored, text_of

SCOPE = 256
KINDS = ("assign", "access", "hex", "short_assign", "short_access", "short_hex", "ident", "opaque", "endpoint")
BASE = 3
#: The role of each kind in a credential.
ROLES = {"secret": (0, 2, 3, 5, 7), "identifier": (1, 4, 6), "endpoint": (8,)}

# Fixed patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
# Patterns of the weak kinds.
SHORT_HEX = r"[0-9a-f]{16,}"
IDENT = (
    r"""(?i:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}"""
    r"""|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+"""
)
OPAQUE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = (
    r"""[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>\x00]+"""
    r"""|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9.]*[0-9])"""
)


def _patterns() -> tuple[tuple, ...]:
    """Pattern, a cheap condition that every text with a match fulfils, and which matches count."""
    sign = lambda t: t.contains("=") | t.contains(":")
    # The second group is greedy and ends the match; signs before it may also be of its kind.
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2))
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return (
        (ASSIGN, sign, lambda m: value(m) >= 8),
        (ACCESS, lambda t: t.contains("AKIA"), lambda m: F.length(m) >= 16),
        (HEX, lambda t: t.rlike(r"[0-9a-f]{32}"), lambda m: F.lit(True)),
        (ASSIGN, sign, lambda m: value(m).between(3, 7)),
        (ACCESS, lambda t: t.contains("AKIA"), lambda m: F.length(m).between(8, 15)),
        (SHORT_HEX, lambda t: t.rlike(r"[0-9a-f]{16}"), lambda m: (F.length(m) < 32) & mixed(m)),
        (IDENT, lambda t: sign(t) | t.contains("@"), lambda m: F.lit(True)),
        (OPAQUE, lambda t: t.rlike(r"[A-Za-z0-9+/_-]{20}"), mixed),
        (ENDPOINT, lambda t: t.contains("://") | t.rlike(r"[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]"), lambda m: F.lit(True)),
    )


SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
LINK = "array<struct<start:bigint,kind:int,end:bigint,mate:struct<start:bigint,kind:int,end:bigint>>>"


def _sums_before(x: Column) -> Column:
    """For each element of an array of numbers the sum of those before it, by blocks of 64."""
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / 64).cast("int")), lambda b: add(F.slice(x, b * 64 + 1, 64)))

    def each(totals: Column) -> Column:
        before = lambda k: F.floor(k / 64).cast("int")
        return F.transform(x, lambda v, k: totals[before(k)] + add(F.slice(x, before(k) * 64 + 1, k % 64)))

    return let(blocks, lambda b: let(F.transform(b, lambda v, k: add(F.slice(b, 1, k))), each))


def _spans(text: Column, kind: int) -> Column:
    """The spans of one kind, in order of start."""
    pattern, may, counts = _patterns()[kind]

    def from_matches(m: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        steps = F.zip_with(F.slice(pieces, 1, F.size(m)), m, lambda p, x: F.length(p) + F.length(x))

        def place(lengths: Column) -> Column:
            rows = F.zip_with(
                F.arrays_zip(_sums_before(lengths).alias("before"), lengths.alias("step")),
                m,
                lambda b, x: F.struct(
                    (b["before"] + b["step"] - F.length(x)).alias("start"), F.lit(kind).alias("kind"), (b["before"] + b["step"]).alias("end"), counts(x).alias("counts")
                ),
            )
            return F.transform(F.filter(rows, lambda r: r["counts"]), lambda r: F.struct(r["start"].cast("long").alias("start"), r["kind"].alias("kind"), r["end"].cast("long").alias("end")))

        return F.when(F.size(m) > 0, let(steps, place)).otherwise(F.array().cast(SPAN))

    return F.when(may(text), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), from_matches)).otherwise(F.array().cast(SPAN))


def _replaced(text: Column, kind: int, by) -> Column:
    """The text with each counting match replaced by by(match)."""
    pattern, may, counts = _patterns()[kind]
    join = lambda m: F.array_join(
        F.zip_with(F.split(text, pattern, -1), m, lambda p, x: F.concat(p, F.when(x.isNull(), F.lit("")).when(counts(x), by(x)).otherwise(x))), ""
    )
    return F.when(may(text), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), join)).otherwise(text)


def base_spans(text: Column) -> Column:
    return F.concat(*[_spans(text, k) for k in range(BASE)])


def weak_spans(text: Column) -> Column:
    """Candidates of the weak kinds outside base spans, which are blanked first."""
    blank = lambda m: F.repeat(F.lit("\x00"), F.length(m))

    def of(t: Column) -> Column:
        return F.concat(*[_spans(t, k) for k in range(BASE, len(KINDS))])

    def blanked(t: Column, k: int) -> Column:
        return of(t) if k == BASE else let(_replaced(t, k, blank), lambda u: blanked(u, k + 1))

    maybe = text.contains("=") | text.contains(":") | text.contains("@") | text.rlike("[0-9]")
    return F.when(maybe, let(text, lambda t: blanked(t, 0))).otherwise(F.array().cast(SPAN))


def linked(found: DataFrame, row: str, spans: str, scope: int = SCOPE) -> DataFrame:
    """row and links: the spans of a row that have a complement within scope, each with the nearest."""
    parts = found.where(F.size(spans) > 1).select(F.col(row).alias("row"), F.explode(spans).alias("p")).select("row", "p.*")
    w = Window.partitionBy("row").orderBy("start", "kind", "end")
    own = F.struct("start", "kind", "end")
    mate = {}
    for role, kinds in ROLES.items():
        mine = F.col("kind").isin(*kinds)
        # The last to end before, and the first to start after.
        left = F.max(F.when(mine, F.struct(F.col("end").alias("at"), own.alias("s")))).over(w.rowsBetween(Window.unboundedPreceding, -1))
        right = F.min(F.when(mine, F.struct(F.col("start").alias("at"), own.alias("s")))).over(w.rowsBetween(1, Window.unboundedFollowing))
        near = lambda gap, side, s: F.when(gap <= scope, F.struct(F.greatest(gap, F.lit(0)).alias("gap"), F.lit(side).alias("side"), s.alias("s")))
        mate[role] = F.least(near(F.col("start") - left["at"], 0, left["s"]), near(right["at"] - F.col("end"), 1, right["s"]))
    of = F.when(F.col("kind").isin(*ROLES["secret"]), F.least(mate["identifier"], mate["endpoint"])).otherwise(mate["secret"])
    links = parts.withColumn("mate", of["s"]).where("mate is not null")
    return links.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "mate"))).cast(LINK).alias("links"))


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, str]:
    """The kept columns of each row of docs and a struct of its findings, and the struct's name.

    The struct has base and weak, arrays of spans (weak ones that are linked), and links, each
    linked span with its nearest complement.
    """
    t = text_of(F.col(f"`{text}`"))
    row, base, weak, out = fresh(docs, "row", "base", "weak", "found")
    columns = [F.col(f"`{c}`") for c in keep]
    held = stored(docs.select(*columns, F.monotonically_increasing_id().alias(row), F.sort_array(base_spans(t)).alias(base), weak_spans(t).alias(weak)), "secrets")
    several = F.size(base) + F.size(weak) > 1
    links = linked(held.where(several).select(F.col(row).alias("row"), F.concat(base, weak).alias("spans")), "row", "spans")
    plain = held.where(~several).withColumn(out, F.struct(F.col(base).alias("base"), F.array().cast(SPAN).alias("weak"), F.array().cast(LINK).alias("links")))
    links = links.select(F.col("row").alias(f"{row}_"), F.struct("links").alias(out))
    others = held.where(several).join(links, F.col(row) == F.col(f"{row}_"), "left")
    every = F.coalesce(F.col(out)["links"], F.array().cast(LINK))
    only = F.transform(F.filter(every, lambda x: x["kind"] >= BASE), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    others = others.withColumn(out, F.struct(F.col(base).alias("base"), only.alias("weak"), every.alias("links")))
    return plain.select(*columns, out).unionByName(others.select(*columns, out)), out


def _named(s: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas, by start and then kind."""
    return F.array_join(F.transform(F.sort_array(spans), _named), ",")


def listed_links(links: Column) -> Column:
    """Linked spans and their complements as kind:start:end>kind:start:end, joined by commas."""
    return F.array_join(F.transform(links, lambda x: F.concat(_named(x), F.lit(">"), _named(x["mate"]))), ",")


def _cut(text: Column, spans: Column, mark: str) -> Column:
    """The text with the union of the spans replaced by the mark."""
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(text, (acc["at"] + 1).cast("int"), F.greatest(F.lit(0), s["start"] - acc["at"]).cast("int"))
        sign = F.when((s["start"] < acc["at"]), F.lit("")).otherwise(F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, sign).alias("out"))

    done = lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int")))
    return F.aggregate(F.sort_array(spans), first, step, done)


def redacted(docs: DataFrame, text: str = "text", length: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with every reported span of the text replaced by the mark; null texts stay null.

    A length column, if named and there, counts the code points of texts that are changed.
    """
    out, found = scan(docs, text, tuple(docs.columns))
    raw, (new,) = F.col(f"`{text}`"), fresh(out, "new")
    spans = F.concat(F.col(found)["base"], F.col(found)["weak"])
    out = out.withColumn(new, F.when(F.size(spans) > 0, _cut(text_of(raw), spans, mark)).otherwise(raw))
    changes = {text: F.col(new)}
    if length is not None and length in docs.columns:
        changes[length] = F.when(F.size(spans) > 0, F.length(new).cast(docs.schema[length].dataType)).otherwise(F.col(f"`{length}`"))
    return out.select(*[changes.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
