"""Secret scanning with corpus-wide ownership frequency.

Every whole text is scanned for candidate credentials by JVM regular
expressions; each match is located by the lengths of the pieces between the
matches. Candidates are then hashed and counted over the whole corpus by the
distinct repositories and owners that hold them: a string that many owners hold
is a widely copied example, one that a single owner holds looks live. The base
kinds are always reported; the extra kinds of the method (access tokens of
known shape, private-key headers) are reported only where they look live.

Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, stored


@dataclass(frozen=True)
class Kind:
    """``pattern`` matches leftmost and without overlap; ``secret`` is the regex
    that cuts the secret out of a match; shorter secrets than ``least`` code
    points drop the match, after it has used up its text."""

    name: str
    pattern: str
    secret: str
    least: int


# Fixed values of the contract: kinds, their patterns and least lengths, in order.
_ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE_KINDS = (
    Kind("assign", _ASSIGN_HEAD + r"[A-Za-z0-9+/_.=-]+", "^" + _ASSIGN_HEAD + r"([A-Za-z0-9+/_.=-]+)$", 12),
    Kind("access", r"AKIA[A-Z0-9]+", r"^(.*)$", 18),
    Kind("hex", r"[0-9a-f]+", r"^(.*)$", 16),
)
# Shapes of further credentials, reported where one owner alone holds them.
EXTRA_KINDS = (
    Kind("forge", r"(?:ghp|gho|ghs|glpat)[_-][A-Za-z0-9_-]{20,}", r"^(.*)$", 24),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"^(.*)$", 24),
    Kind("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{40,}", r"^(.*)$", 60),
)


def spans(text: Column, kind: Kind, rank: int) -> Column:
    """array<struct<start, rank, kind, end, secret>> of the matches of one kind; the secret as its SHA-256, never in clear.

    ``split`` and ``regexp_extract_all`` walk the same matches, so piece i ends
    where match i begins; ``length`` counts code points. Text without a match
    costs one search.
    """
    pattern = kind.pattern if kind.name != "hex" else f"[0-9a-f]{{{kind.least},}}"  # runs are whole, so these are the same
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    one = "array<struct<start:bigint,rank:int,kind:string,end:bigint,secret:string>>"
    empty = F.array().cast(one)
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("part"), F.array().cast(f"array<{one}>").alias("full"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["piece"])
        end = begin + F.length(pair["match"])
        secret = F.regexp_extract(pair["match"], kind.secret, 1) if kind.secret != r"^(.*)$" else pair["match"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), end.alias("end"), F.sha2(secret.cast("binary"), 256).alias("secret"))
        part = F.when(F.length(secret) >= kind.least, F.concat(acc["part"], F.array(span))).otherwise(acc["part"])
        return F.struct(
            end.alias("at"),
            F.when(F.size(acc["part"]) >= 500, F.when(F.length(secret) >= kind.least, F.array(span)).otherwise(empty)).otherwise(part).alias("part"),
            F.when(F.size(acc["part"]) >= 500, F.concat(acc["full"], F.array(acc["part"]))).otherwise(acc["full"]).alias("full"),
        )

    pairs = F.zip_with(
        F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(p.alias("piece"), m.alias("match"))
    )
    found = F.aggregate(pairs, start, step, lambda acc: F.flatten(F.concat(acc["full"], F.array(acc["part"]))))
    return F.when(text.rlike(pattern), found).otherwise(empty)


def candidates(docs: DataFrame, id_col: str, text_col: str, repository: str, owner: str, kinds: tuple[Kind, ...]) -> DataFrame:
    """(id, repository, owner, spans): every row, its spans by start and kind."""
    text = F.coalesce(col(text_col), F.lit(""))
    cols = [col(c).alias(a) for c, a in ((id_col, "id"), (repository, "repository"), (owner, "owner"))]
    found = F.array_sort(F.concat(*[spans(F.col("body"), k, i) for i, k in enumerate(kinds)]))
    return docs.select(*cols, text.alias("body")).select("id", "repository", "owner", found.alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """(secret_hash, n_repositories, n_owners, n_seen) over the whole corpus.

    Two levels of aggregation: first by (hash, repository, owner), which folds a
    secret that a third of the rows hold within each task, then by hash. Null
    repositories and owners count as one each.
    """
    each = found.select("repository", "owner", F.explode("spans").alias("s")).select(
        "repository", "owner", F.col("s.secret").alias("secret_hash")
    )
    held = each.groupBy("secret_hash", "repository", "owner").agg(F.count(F.lit(1)).alias("n"))
    null = F.lit("\u0000null")
    return held.groupBy("secret_hash").agg(
        F.countDistinct(F.coalesce(F.col("repository").cast("string"), null)).alias("n_repositories"),
        F.countDistinct(F.coalesce(F.col("owner").cast("string"), null)).alias("n_owners"),
        F.sum("n").alias("n_seen"),
    )


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repository: str = "source",
    owner: str = "source",
    example_owners: int = 3,
) -> DataFrame:
    """One row for each row of ``docs``: id, spans, n_live, n_example.

    ``spans`` is array<struct<start, rank, kind, end, live>> in code points, end
    exclusive, ordered by start and then kind. A secret held by ``example_owners``
    or more distinct owners, or repositories, is an example; by fewer, live. Base
    kinds are reported either way, extra kinds only when live. Null text is
    empty; rows without a match have an empty array; repeated rows are reported
    each (their copies count as one holder); an empty table gives none. Columns
    other than the four named are not read.
    """
    kinds = BASE_KINDS + EXTRA_KINDS
    found = stored(
        candidates(docs, id_col, text_col, repository, owner, kinds).withColumn("row_key", F.monotonically_increasing_id()), "spans"
    )
    wide = (F.col("n_owners") >= example_owners) | (F.col("n_repositories") >= example_owners)
    owned = stored(ownership(found).select("secret_hash", wide.alias("example")), "ownership")
    judged = (
        found.select("row_key", F.explode("spans").alias("s"))
        .withColumn("secret_hash", F.col("s.secret"))
        .join(owned, "secret_hash")
        .where((F.col("s.rank") < len(BASE_KINDS)) | ~F.col("example"))
        .groupBy("row_key")
        .agg(F.collect_list(F.struct("s.start", "s.rank", "s.kind", "s.end", (~F.col("example")).alias("live"))).alias("out"))
    )
    empty = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,live:boolean>>")
    out = F.array_sort(F.coalesce("out", empty))
    return (
        found.select("row_key", "id")
        .join(judged, "row_key", "left")
        .select("id", out.alias("spans"))
        .select(
            "id",
            "spans",
            F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
            F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_example"),
        )
    )
