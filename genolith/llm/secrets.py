"""Multipart credential linking, in DataFrame functions only.

A credential is often told in parts: an access identifier, a secret and an endpoint. Base patterns (assign, access,
hex) are secrets or identifiers by themselves. Weak candidates (user names, loose passwords and long random tokens,
endpoints) are reported only when a complementary part stands in the same scope, within SCOPE code points: an
identifier needs a secret, a weak secret needs an identifier or an endpoint, an endpoint needs a secret.

Matches have no positions in SQL; here the text between the matches (split by the same pattern) and the matches
themselves give them, as a running sum of lengths. The interval join of parts measures the gap between their ends and
starts: running windows over each document's parts, forward and backward, tell the farthest end and the first start of
the complementary parts, and so the nearest partner of each part, without making a row for each pair.

Defined cases. Null or empty text: no spans. Null doc_id: rows are told apart by their text. Repeated rows (same
doc_id and text) get the same spans each. Texts of any length are scanned whole; their parts are rows, not one array.
Ties (spans at one start): ordered by kind as listed. Empty table: no rows. Only doc_id and text are read by `find`;
`redact` keeps all columns under their own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPE = 200

#: kind: (Java pattern, group whose length counts, least length, role). Base kinds come first.
KINDS = {
    "assign": (r"""(?=[pPsStTaA])(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12, "secret"),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18, "ident"),
    "hex": (r"[0-9a-f]{16,}+", 0, 16, "secret"),
    "ident": (r"""(?<![A-Za-z0-9_])(?=[uUlLaAcC])(?i:user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20{0,9}[:=]\x20{0,9}["']?([A-Za-z0-9@._-]{3,64})""", 1, 3, "weak_ident"),
    "weak": (r"""(?<![A-Za-z0-9_])(?=[pPsStTcCaA])(?i:(?:pass|pwd|passphrase|private_?key|credentials?|auth)["']?\x20{0,9}[:=]\x20{0,9}["']?[^\s"'<>]{6,}+|(?:password|passwd|secret|token|api_?key)["']?\x20{0,9}[:=]\x20{0,9}["']?[^\s"'<>]{4,}+)""", 0, 6, "weak_secret"),
    "random": (r"[A-Za-z0-9+/]{32,}+={0,2}", 0, 32, "weak_secret"),
    "endpoint": (r"(?i:(?<![A-Za-z0-9])(?:https?|ftp|jdbc:[a-z]{2,12}|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]{3,512})", 0, 3, "endpoint"),
}
#: Strings of which a text holds one if it holds a match; they spare most texts the pattern.
NEEDS = {"assign": (":", "="), "access": ("AKIA",), "ident": (":", "="), "weak": (":", "="), "endpoint": ("://",)}
#: A random token mixes digits, capitals and small letters.
MIXED = {"random": ("[0-9]", "[A-Z]", "[a-z]")}
BASE_KINDS = ("assign", "access", "hex")
ORDER = {kind: i for i, kind in enumerate(KINDS)}


def _matches(text: Column, kind: str) -> Column:
    """All matches of a kind, also failing ones; null where a text can't have any."""
    found = F.regexp_extract_all(text, F.lit(KINDS[kind][0]), F.lit(0))
    if kind not in NEEDS:
        return found
    may = F.lit(False)
    for x in NEEDS[kind]:
        may = may | text.contains(x)
    return F.when(may, found)


def _parts(text: Column, kind: str) -> Column:
    """A kind's matches (column __<kind>) as (kind number, place among them, length of the text before since the last, length, whether it passes)."""
    pattern, group, least, _ = KINDS[kind]
    whole = F.col(f"__{kind}")
    own = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    between = F.split(text, pattern, -1)

    def passes(x: Column) -> Column:
        out = F.length(x["g"]) >= least
        for need in MIXED.get(kind, ()):
            out = out & x["m"].rlike(need)
        return out

    parts = F.transform(
        F.arrays_zip(whole.alias("m"), own.alias("g"), F.slice(between, F.lit(1), F.size(whole)).alias("b")),
        lambda x, i: F.struct(F.lit(ORDER[kind]).alias("kind"), i.alias("place"), F.length(x["b"]).alias("gap"), F.length(x["m"]).alias("len"), passes(x).alias("passes")),
    )
    return F.when(F.size(whole) > 0, parts).otherwise(F.array().cast("array<struct<kind:int,place:int,gap:int,len:int,passes:boolean>>"))


def keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """docs with __key, which rows of the same doc_id and text share; rows without text have one each, that no text has."""
    own = F.sha2(F.concat_ws("\x01", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.col(text)), 256)
    return docs.withColumn("__key", F.when(F.length(text) > 0, own).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))))


def linked_parts(rows: DataFrame, text: str, scope: int = SCOPE) -> DataFrame:
    """__key, spans: the spans of each text that has any, as array<struct<start, kind, end, partner>> in order."""
    every = F.concat(*(_parts(F.col(text), kind) for kind in KINDS))
    parts = (
        rows.where(F.length(text) > 0)
        .select("__key", text, *(_matches(F.col(text), kind).alias(f"__{kind}") for kind in KINDS))
        .where(F.greatest(*(F.size(f"__{kind}") for kind in KINDS)) > 0)
        .select("__key", every.alias("parts"))
        .groupBy("__key").agg(F.first("parts").alias("parts"))  # repeated rows are one before they are dealt out
        .select("__key", F.explode("parts").alias("p"))
        .select("__key", "p.*")
    )
    before = Window.partitionBy("__key", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("len")).over(before)
    placed = parts.withColumn("end", end).where("passes").select("__key", "kind", (F.col("end") - F.col("len")).alias("start"), "end")
    # a loose password that an assignment covers is that assignment
    earlier = Window.partitionBy("__key").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    covered = F.coalesce(F.max(F.when(F.col("kind") == ORDER["assign"], F.col("end"))).over(earlier) >= F.col("end"), F.lit(False))
    placed = placed.withColumn("covered", covered).where((F.col("kind") != ORDER["weak"]) | ~F.col("covered")).drop("covered")
    role = F.element_at(F.create_map(*(x for k, v in KINDS.items() for x in (F.lit(ORDER[k]), F.lit(v[3])))), F.col("kind"))
    placed = placed.withColumn("role", role)
    later = Window.partitionBy("__key").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    role = F.col("role")

    def partner(*roles: str) -> Column:
        """The start of the nearest part of these roles in reach: the farthest end of those that begin before, or the first start of those after."""
        own = F.when(role.isin(*roles), F.struct("end", "start"))
        back, on = F.max(own).over(earlier), F.min(F.when(role.isin(*roles), F.struct("start", "end"))).over(later)
        gap = F.when(back.isNotNull(), F.greatest(F.col("start") - back["end"], F.lit(0)))
        ahead = F.when(on.isNotNull(), F.greatest(on["start"] - F.col("end"), F.lit(0)))
        return (
            F.when((gap <= scope) & (ahead.isNull() | (gap <= ahead)), back["start"])
            .when(ahead <= scope, on["start"])
        )

    beside = (
        F.when(role.isin("ident", "weak_ident"), partner("secret", "weak_secret"))
        .when(role.isin("secret", "weak_secret"), partner("ident", "weak_ident", "endpoint"))
        .when(role == "endpoint", partner("secret", "weak_secret"))
    )
    told = placed.withColumn("partner", beside).where(role.isin("ident", "secret") | F.col("partner").isNotNull())
    return told.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "partner"))).alias("spans"))


SPANS = "array<struct<start:bigint,kind:int,end:bigint,partner:bigint>>"


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """doc_id and spans (array<struct<start, kind, end, partner>>, empty if none) of every row; partner: the start of the part that a span is linked with, if any."""
    rows = keyed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "doc_id")
    found = linked_parts(rows, "text", scope)
    return rows.select("doc_id", "__key").join(found, "__key", "left").select("doc_id", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def redact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scope: int = SCOPE, mark: str = "[SECRET]") -> DataFrame:
    """docs with every reported identifier and secret replaced by a mark; all rows and columns stay."""
    rows = keyed(docs, text, doc_id)
    found = linked_parts(rows, text, scope).withColumn("spans", F.filter("spans", lambda s: s["kind"] != ORDER["endpoint"])).where(F.size("spans") > 0)
    merged = F.aggregate(
        "spans", F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda out, s: F.when(
            (F.size(out) > 0) & (F.element_at(out, -1)["end"] >= s["start"]),
            F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(out, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    body = F.col(text)
    # the text before each span and after the last one
    kept = F.transform(
        F.sequence(F.lit(0), F.size("__spans")),
        lambda i: body.substr(
            F.when(i > 0, F.get("__spans", i - 1)["end"]).otherwise(F.lit(0)).cast("int") + 1,
            (F.when(i < F.size("__spans"), F.get("__spans", i)["start"]).otherwise(F.length(body)) - F.when(i > 0, F.get("__spans", i - 1)["end"]).otherwise(F.lit(0))).cast("int"),
        ),
    )
    cut = F.when(F.col("__spans").isNotNull(), F.array_join(kept, mark)).otherwise(body)
    return rows.join(found.select("__key", merged.alias("__spans")), "__key", "left").withColumn(text, cut).select(*docs.columns)


def told(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op5_linked_secrets(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == ORDER[kind])).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] < len(BASE_KINDS))
    linked = F.filter("spans", lambda s: s["partner"].isNotNull())
    links = F.array_join(F.transform(linked, lambda s: F.concat_ws(":", s["start"], s["partner"])), ",")
    return found.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), links.alias("links"))
