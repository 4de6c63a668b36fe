"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong kinds (``assign``, ``access``, ``hex``) are always reported. Weak kinds (``id``, ``key``, ``endpoint``) are
joined by interval: a candidate is reported only if complementary parts start within ``scope`` code points of it.
Matches of one kind never overlap, so the parts that can start within a scope are few and known beforehand; the join
looks at that many neighbours in order of position, which makes it linear in the number of parts of a text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import table, text_of

#: kind, pattern, shortest match, role. The order is the order of kinds that start at the same place.
STRONG = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, "secret"),
    ("access", r"AKIA[A-Z0-9]{16,}", 20, "access"),
    ("hex", r"[0-9a-f]{24,}", 24, "secret"),
)
_IS = r"""["']?\x20*[:=]\x20*["']?"""
WEAK = (
    ("id", rf"(?i)(?:access_?key_?id|client_?id|user_?name|login|account){_IS}[a-z0-9._@-]{{4,}}", 10, "access"),
    ("key", rf"(?i)(?:access_?key|private_?key|passphrase|pwd|credential){_IS}[a-z0-9+/_.=-]{{6,}}", 10, "secret"),
    ("endpoint", r"(?i)(?:https?|ftp|amqps?|redis|mongodb|mysql|postgres(?:ql)?)://[a-z0-9._~:/?#@!$&*+=%-]{4,}", 10, "endpoint"),
)
#: What has to start within the scope of a weak candidate: for each kind, alternatives of roles that are needed together.
NEEDS = {"id": (("secret",),), "key": (("access",), ("endpoint",)), "endpoint": (("access", "secret"),)}
SCOPE = 200
RUN = 256
_PART = "struct<start:int,nth:int,end:int,kind:string,role:string>"


def _found(text: Column, nth: int, kind: str, pattern: str, role: str) -> Column:
    """Array of the parts of a kind, by position; the gaps between the matches give the positions."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    ok = (lambda m: F.length(F.regexp_extract(m, pattern, 2)) >= 6) if kind == "assign" else (lambda m: F.lit(True))
    steps = F.filter(F.zip_with(F.split(text, pattern, -1), matches, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("len"), m.isNotNull().alias("hit"), F.when(m.isNotNull(), ok(m)).otherwise(False).alias("ok"))), lambda x: x["hit"])
    empty = F.from_json(F.lit("[]"), f"array<{_PART}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        part = F.struct(start.alias("start"), F.lit(nth).alias("nth"), (start + x["len"]).alias("end"), F.lit(kind).alias("kind"), F.lit(role).alias("role"))
        return F.struct((start + x["len"]).alias("at"), F.when(x["ok"], F.concat(acc["parts"], F.array(part))).otherwise(acc["parts"]).alias("parts"))

    def run(all_steps: Column) -> Column:
        """Places within each run of matches; adding to an array copies it, so no array that grows is longer than a run."""
        runs = F.sequence(F.lit(0), F.greatest(F.floor((F.size(all_steps) - 1) / RUN), F.lit(0)).cast("int"))
        return F.transform(runs, lambda r: F.aggregate(F.slice(all_steps, r * RUN + 1, F.lit(RUN)), F.struct(F.lit(0).alias("at"), empty.alias("parts")), step))

    def moved(runs: Column) -> Column:
        begins = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), "array<int>").alias("all")), lambda acc, r: F.struct((acc["at"] + r["at"]).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")))["all"]
        return F.flatten(F.zip_with(runs, begins, lambda r, b: F.transform(r["parts"], lambda p: F.struct((p["start"] + b).alias("start"), p["nth"].alias("nth"), (p["end"] + b).alias("end"), p["kind"].alias("kind"), p["role"].alias("role")))))

    whole = F.get(F.transform(F.transform(F.array(steps), run), moved), F.lit(0))  # arrays of one bind a value to a name
    return F.when(text.rlike(pattern), whole).otherwise(empty)


def _written(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per input row: the id, counts of the strong kinds, ``base_sha256`` and ``spans`` (``kind:start:end``).

    Positions are code points, ends exclusive. ``n_linked`` counts the weak parts that complementary parts confirm.
    Null text: empty, which gives no span, the digest of the empty string and empty ``spans``. Ids may be null or
    repeat: each row is judged alone. Other columns are ignored. An empty table gives an empty result.
    """
    kinds = [(n, *k) for n, k in enumerate((*STRONG, *WEAK))]
    text = F.col("_text")
    rows = docs.select(F.col(id_col).alias("_row"), text_of(text_col).alias("_text"))
    rows = rows.withColumns({f"_{k}": _found(text, n, k, p, role) for n, k, p, _, role in kinds[:3]})
    none = F.from_json(F.lit("[]"), f"array<{_PART}>")
    n, k, p, _, role = kinds[4]
    rows = rows.withColumn("_key", _found(text, n, k, p, role))
    secrets = F.size("_assign") + F.size("_hex") + F.size("_key") > 0  # no weak part is ever reported without one
    rows = rows.withColumns({f"_{k}": F.when(secrets, _found(text, n, k, p, role)).otherwise(none) for n, k, p, _, role in (kinds[3], kinds[5])})
    rows = rows.withColumn("_base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    rows = rows.withColumn("_weak", F.concat("_id", "_key", "_endpoint"))
    near = sum(scope // least + 1 for _, _, _, least, _ in kinds)
    parts = F.array_sort(F.concat("_base", "_weak"))
    rows = rows.withColumn("_parts", F.when(F.size("_weak") > 0, parts).otherwise(F.col("_base")))

    def linked(p: Column, i: Column) -> Column:
        around = F.slice(F.col("_parts"), F.greatest(i + 1 - near, F.lit(1)), F.lit(2 * near + 1))
        has = lambda role: F.exists(around, lambda q: (q["role"] == role) & (F.abs(q["start"] - p["start"]) <= scope))
        test = F.lit(False)
        for kind, ways in NEEDS.items():
            test = F.when(p["kind"] == kind, reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, map(has, way)) for way in ways])).otherwise(test)
        return (p["nth"] < len(STRONG)) | test

    rows = rows.withColumn("_all", F.when(F.size("_weak") > 0, F.filter("_parts", linked)).otherwise(F.col("_base")))
    count = lambda c: F.size(c).cast("long")
    return rows.select(
        F.col("_row").alias(id_col), count("_assign").alias("n_assign"), count("_access").alias("n_access"), count("_hex").alias("n_hex"),
        F.sha2(_written(F.col("_base")).cast("binary"), 256).alias("base_sha256"), _written(F.col("_all")).alias("spans"),
        (count("_all") - count("_base")).alias("n_linked"),
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def _needed(kind: str, ways: tuple) -> str:
    has = lambda role: f"exists (select 1 from parts q where q.doc_id = p.doc_id and q.role = '{role}' and abs(q.place - p.place) <= {SCOPE})"
    return f"kind = '{kind}' and ({' or '.join('(' + ' and '.join(map(has, way)) + ')' for way in ways)})"


_KINDS = ", ".join("({}, '{}', '{}', '{}')".format(n, k, role, p.replace("'", "''")) for n, (k, p, _, role) in enumerate((*STRONG, *WEAK)))
OP1_SQL = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
     k(nth, kind, role, pattern) as (values {_KINDS}),
     found as (select doc_id, nth, kind, role, pattern, regexp_extract_all(t, pattern) as hits, string_split_regex(t, pattern) as gaps
               from d cross join k where regexp_matches(t, pattern)),
     each as (select doc_id, nth, kind, role, pattern, unnest(range(1, len(hits) + 1)) as i, hits, gaps from found),
     sized as (select doc_id, nth, kind, role, pattern, i, hits[i] as hit, length(gaps[i]) as gap, length(hits[i]) as size from each),
     placed as (select *, cast(sum(gap) over w + sum(size) over w - size as bigint) as place from sized window w as (partition by doc_id, nth order by i)),
     parts as (select doc_id, nth, kind, role, place, concat(kind, ':', place, ':', place + size) as span from placed
               where kind <> 'assign' or length(regexp_extract(hit, pattern, 2)) >= 6),
     kept as (select * from parts p where nth < {len(STRONG)} or {" or ".join(_needed(k, ways) for k, ways in NEEDS.items())})
select d.doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
       sha256(coalesce(string_agg(span, ',' order by place, nth) filter (nth < {len(STRONG)}), '')) as base_sha256,
       coalesce(string_agg(span, ',' order by place, nth), '') as spans, count(*) filter (nth >= {len(STRONG)}) as n_linked
from d left join kept using (doc_id) group by d.doc_id
"""
