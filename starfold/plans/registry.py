"""Registry of runnable queries and their SQL equivalents."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Comparable output: integers as bigint, floats as double rounded to six decimals without negative zero."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, oracle: str | None = None):
    """Register a query under a name, with the SQL that gives the same rows."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # the SQL twins read zone-less times as UTC
            return plain(fn(spark, sf_dir))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = sql(oracle)
        return fn

    return wrap


# SQL twins of the views.
VIEWS = {
    "items": """SELECT event_id AS id, event_type AS event, user_id AS owner, epoch_us(ts) AS t,
      CAST(least(floor(value / 25), 5) AS INTEGER) AS star, value FROM events""",
    "shots": """SELECT id, event, owner, t, star, value,
        CAST(sum(CASE WHEN d > 259200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY event, owner ORDER BY t, id) AS BIGINT) AS seg,
        CAST(sum(CASE WHEN d > 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY event, owner ORDER BY t, id) AS BIGINT) AS cluster
      FROM (SELECT *, t - lag(t) OVER (PARTITION BY event, owner ORDER BY t, id) AS d FROM items)""",
    "clustered": """SELECT *, CAST(star = cluster_cap AS INTEGER) AS is_top FROM (
        SELECT *, count(*) OVER (PARTITION BY event, owner, cluster) AS cluster_size,
          max(star) OVER (PARTITION BY event, owner, cluster) AS cluster_cap FROM shots)""",
    "scored": """SELECT *, (star * 20 + {hash:a:id} % 100) / 200.0::DOUBLE AS score_a,
        (least(value, 500.0::DOUBLE) / 5 + {hash:b:id} % 100) / 200.0::DOUBLE AS score_b FROM clustered""",
    "itemscores": """SELECT *, (star * 20 + {hash:a:id} % 100) / 200.0::DOUBLE AS score_a,
        (least(value, 500.0::DOUBLE) / 5 + {hash:b:id} % 100) / 200.0::DOUBLE AS score_b FROM items""",
    "vectors": """SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS BIGINT) AS label FROM embeddings""",
    "vshots": """SELECT c.*, e.v FROM clustered c JOIN vectors e ON e.vec_id = c.id % (SELECT count(*) FROM embeddings)""",
    "cvshots": """SELECT *, CASE WHEN h % 10 = 0 THEN NULL ELSE (h % 1000) / 1000.0::DOUBLE END AS sharp,
        CASE WHEN (h >> 7) % 10 = 0 THEN NULL ELSE ((h >> 7) % 1000) / 1000.0::DOUBLE END AS shake,
        CASE WHEN (h >> 14) % 10 = 0 THEN NULL ELSE ((h >> 14) % 1000) / 1000.0::DOUBLE END AS contrast
      FROM (SELECT *, {hash:cv:id} AS h FROM vshots)""",
    "splits": """SELECT *, CASE WHEN {hash:split:owner} % 10 < 6 THEN 'train' WHEN {hash:split:owner} % 10 < 8 THEN 'val' ELSE 'test' END AS split
      FROM scored""",
    "exam": """SELECT gid, substr('ABCDEF', slot + 1, 1) AS anon, id, event, owner, t, star, value, size,
        greatest(0, least(5, star + ({hash:u:id} % 3) - 1))::INTEGER AS user_star
      FROM (SELECT *, count(*) OVER (PARTITION BY gid) AS size FROM (
        SELECT *, (pos - 1) % 6 AS slot, event || '/' || owner || '/' || ((pos - 1) // 6) AS gid FROM (
          SELECT *, row_number() OVER (PARTITION BY event, owner ORDER BY t, id) AS pos FROM items))) WHERE size >= 2""",
    "rounds": """SELECT gid, id, 0 AS rnd, greatest(0, least(5, star + ({hash:round0:id} % 3) - 1))::INTEGER AS user_star FROM exam
      UNION ALL SELECT gid, id, 1, greatest(0, least(5, star + ({hash:round1:id} % 3) - 1))::INTEGER FROM exam
      UNION ALL SELECT gid, id, 2, greatest(0, least(5, star + ({hash:round2:id} % 3) - 1))::INTEGER FROM exam""",
    "segvec": "SELECT vec_id AS id, label AS event, v FROM vectors",
    "vecpairs": """SELECT a.label AS event, a.vec_id AS id_i, b.vec_id AS id_j, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS cos
      FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id < b.vec_id""",
}


def hash_sql(seed: str, *cols: str) -> str:
    """SQL twin of ``core.hash_int``."""
    text = " || ':' || ".join([f"'{seed}'", *cols])
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def sql(body: str) -> str:
    """Expand ``{hash:seed:col,...}`` marks and prepend the views the body uses."""
    used: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b(FROM|JOIN)\s+{name}\b", text) and name not in used:
                visit(VIEWS[name])
                used.append(name)

    body = body.strip()
    visit(body)
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in used)
    if body.startswith("WITH RECURSIVE"):
        text = f"WITH RECURSIVE {head + ', ' if head else ''}{body[len('WITH RECURSIVE'):]}"
    elif body.startswith("WITH"):
        text = f"WITH {head + ', ' if head else ''}{body[4:]}"
    else:
        text = f"WITH {head}\n{body}" if head else body
    return re.sub(r"\{hash:([^:}]*):([^}]*)\}", lambda m: hash_sql(m[1], *[c.strip() for c in m[2].split(",")]), text)
