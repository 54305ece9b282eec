"""Secret scans, in DataFrame expressions only.

Base spans come from three patterns. The method adds spans of high Shannon entropy: each
candidate string (a run of token characters) is walked once by a higher-order fold that
keeps the symbol counts of the current window; a character that enters and one that leaves
change the sum of c*log2(c) by a table lookup each, so no window is counted anew. Hot
windows merge into maximal spans. Candidates on the allow-list, pieces of them that say they
are samples, and spans that a base span already covers, are suppressed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of fewer characters never starts a longer match, so the length can be in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
BASE_KINDS = ("assign", "access", "hex")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits per character that make a window hot, by the candidate's character class. A random
#: window of 20 hexadecimal digits has 3.4 bits on average, one of 62 or 64 symbols 4.1.
CLASSES = (
    ("entropy_hex", r"^[0-9A-Fa-f]+$", "0123456789abcdef", 3.05),
    ("entropy_alnum", r"^[A-Za-z0-9]+$", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 3.85),
    ("entropy_base64", r"", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-", 3.85),
)
#: Candidates that are no secrets: words of letters with marks between them, identifiers in
#: the form of a UUID, and rulers of one or two symbols.
ALLOW = (
    r"^[-_=+/]*[A-Za-z]?[a-z]*([-_=+/]+[A-Za-z]?[a-z]*)*$|^[A-Z]+([-_=+/]+[A-Z]*)*$"
    r"|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
)
#: Words that mark a sample. One speaks for the piece between / _ = - that holds it, and
#: that piece is cut out of the candidate; what stands beside it is judged on its own.
SAMPLE = r"(?i:example|placeholder|changeme|your[-_]|sample|dummy|abcdefgh|01234567|12345678)"
_PIECE = rf"[A-Za-z0-9+]*{SAMPLE}[A-Za-z0-9+]*"
#: The same, tried only where a piece starts, so that a long piece is read a few times and not at each of its places.
SAMPLE_PIECE = rf"(?<![A-Za-z0-9+]){_PIECE}"
KINDS = (*BASE_KINDS, *(c[0] for c in CLASSES))
_SCALE = 1_000_000
#: Counters of five bits in a long; a window has at most 31 characters.
PACKED = 12


def clogc(n: int) -> list[int]:
    """c * log2(c) for c = 0..n in millionths, so that sums are exact."""
    return [0, *(round(_SCALE * c * math.log2(c)) for c in range(1, n + 1))]


def most(bits: float, window: int) -> int:
    """The largest sum of c*log2(c) of a window with at least ``bits`` bits a character."""
    return math.floor(_SCALE * window * (math.log2(window) - bits))


_SPAN = "array<struct<start:int,end:int,rank:int,value:string>>"


def _matches(text: Column, pattern: str, group: int, least: int, rank: int) -> Column:
    """Spans of the non-overlapping matches whose ``group`` has at least ``least`` characters.

    What stands between matches gives their places: both lists are walked together.
    """
    return F.when(
        text.rlike(pattern),
        F.aggregate(
            F.arrays_zip(
                F.split(text, pattern, -1).alias("gap"),
                F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
                F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
            ),
            F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans")),
            lambda acc, x: F.struct(
                (acc["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["all"]), F.lit(0))).alias("at"),
                F.when(
                    F.length(x["value"]) >= least,
                    F.concat(acc["spans"], F.array(F.struct(
                        (acc["at"] + F.length(x["gap"])).alias("start"),
                        (acc["at"] + F.length(x["gap"]) + F.length(x["all"])).alias("end"),
                        F.lit(rank).alias("rank"), x["value"].alias("value"),
                    ))),
                ).otherwise(acc["spans"]).alias("spans"),
            ),
            lambda acc: acc["spans"],
        ),
    ).otherwise(F.array().cast(_SPAN))


def _hot_spans(candidate: Column, alphabet: str, bits: float, rank: int, window: int) -> Column:
    """Spans of the candidate's hot windows, by one walk with incremental counts.

    The codes of the characters are bound to a lambda variable, so they are made once and a
    step costs the same however long the candidate is; only the last span stays open. Counters
    of five bits lie packed in a few longs, of which a step changes two at most.
    """
    table = F.array(*[F.lit(x) for x in clogc(window)])
    value = F.lower(candidate["value"]) if len(alphabet) == 16 else candidate["value"]

    def count(counts: Column, at: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, at["word"]), at["shift"]).bitwiseAND(31).cast("int")

    def place(code: Column) -> Column:
        """Where a symbol's counter stands and what adds one to it; code 0 has none."""
        shift = ((code - 1) % PACKED * 5).cast("int")
        return F.struct(
            F.when(code > 0, F.floor((code - 1) / PACKED).cast("int")).otherwise(F.lit(0)).alias("word"), F.when(code > 0, shift).otherwise(F.lit(0)).alias("shift"),
            F.when(code > 0, F.call_function("shiftleft", F.lit(1).cast("long"), shift)).otherwise(F.lit(0).cast("long")).alias("one"),
        )

    def span(start: Column, end: Column) -> Column:
        return F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(rank).alias("rank"), F.lit("").alias("value")))

    def walk(acc: Column, x: Column) -> Column:
        enter, leave = x["enter"], x["leave"]
        n_gone = count(acc["counts"], leave)
        gone = F.when(leave["one"] > 0, F.get(table, n_gone) - F.get(table, n_gone - 1)).otherwise(F.lit(0))
        kept = count(acc["counts"], enter) - (enter == leave).cast("int")
        total = acc["total"] - gone + F.get(table, kept + 1) - F.get(table, kept)
        start = candidate["start"] + x["i"] - (window - 1)
        hot = (x["i"] >= window - 1) & (total <= most(bits, window))
        opens = hot & (start > acc["end"])
        return F.struct(
            F.transform(acc["counts"], lambda c, j: c + F.when(j == enter["word"], enter["one"]).otherwise(0) - F.when(j == leave["word"], leave["one"]).otherwise(0)).alias("counts"),
            total.alias("total"), F.when(opens, start).otherwise(acc["start"]).alias("start"), F.when(hot, start + window).otherwise(acc["end"]).alias("end"),
            F.when(opens & (acc["end"] >= 0), F.concat(acc["spans"], span(acc["start"], acc["end"]))).otherwise(acc["spans"]).alias("spans"),
        )

    def over(codes: Column) -> Column:
        steps = F.transform(codes, lambda c, i: F.struct(i.alias("i"), place(c).alias("enter"), place(F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(0))).alias("leave")))
        first = F.struct(
            F.array_repeat(F.lit(0).cast("long"), -(-len(alphabet) // PACKED)).alias("counts"), F.lit(0).alias("total"), F.lit(-1).alias("start"), F.lit(-1).alias("end"),
            F.array().cast(_SPAN).alias("spans"),
        )
        return F.aggregate(steps, first, walk, lambda acc: F.when(acc["end"] >= 0, F.concat(acc["spans"], span(acc["start"], acc["end"]))).otherwise(acc["spans"]))

    codes = F.transform(F.split(value, ""), lambda c: F.position(c, F.lit(alphabet)))
    return F.get(F.transform(F.array(codes), over), F.lit(0))


def _beside_samples(c: Column, window: int) -> Column:
    """What stands beside the sample pieces of a candidate, if a window fits in it."""
    cut = F.aggregate(
        F.arrays_zip(F.split(c["value"], SAMPLE_PIECE, -1).alias("gap"), F.regexp_extract_all(c["value"], F.lit(SAMPLE_PIECE), F.lit(0)).alias("piece")),
        F.struct(c["start"].alias("at"), F.array().cast(_SPAN).alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["piece"]), F.lit(0))).alias("at"),
            F.when(
                F.length(x["gap"]) >= window,
                F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(x["gap"])).alias("end"), F.lit(0).alias("rank"), x["gap"].alias("value")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return F.when(c["value"].rlike(SAMPLE), F.filter(cut, lambda part: ~part["value"].rlike(ALLOW))).otherwise(F.array(c).cast(_SPAN))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, base, spans) for every row of ``docs``.

    ``base`` and ``spans`` are arrays of (start, end, rank, value) in code points, end
    exclusive, ordered by start and then by kind; rank is the place in ``KINDS``. Null and
    empty texts have none; repeated and null ids keep a row each; other columns are ignored.
    ``window`` is 31 characters at most.
    """
    if not 2 <= window <= 31:
        raise ValueError("a window has 2 to 31 characters")
    df = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t_"))
    df = df.select(
        id_col,
        F.concat(_matches(F.col("t_"), ASSIGN, 1, ASSIGN_LEAST, 0), _matches(F.col("t_"), ACCESS, 0, 1, 1), _matches(F.col("t_"), HEX, 0, 1, 2)).alias("base_"),
        F.flatten(F.transform(
            F.filter(_matches(F.col("t_"), CANDIDATE, 0, window, 0), lambda c: ~c["value"].rlike(ALLOW)), lambda c: _beside_samples(c, window),
        )).alias("candidates_"),
    )
    patterns = [c[1] for c in CLASSES]

    def one(c: Column) -> Column:
        hexed, alnum, mixed = (_hot_spans(c, a, bits, KINDS.index(kind), window) for kind, _, a, bits in CLASSES)
        return F.when(c["value"].rlike(patterns[0]), hexed).when(c["value"].rlike(patterns[1]), alnum).otherwise(mixed)

    df = df.withColumn("added_", F.when(F.size("candidates_") > 0, F.flatten(F.transform("candidates_", one))).otherwise(F.array().cast(_SPAN)))
    added = F.filter("added_", lambda s: ~F.exists("base_", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    by_kind = lambda c: F.transform(
        F.array_sort(F.transform(c, lambda s: F.struct(s["start"], s["rank"], s["end"], s["value"]))),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"), s["value"].alias("value")),
    )
    return df.select(id_col, by_kind(F.col("base_")).alias("base"), by_kind(F.concat("base_", added)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span (ordered by start; spans may overlap) replaced by ``mark``."""
    step = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        ),
    )
    return F.concat(step["out"], F.substring(text, step["at"] + 1, F.length(text)))


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    """Contract query: counts, digest and all spans of every document."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return out.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def _oracle() -> str:
    """The scan in DuckDB SQL: every window's counts anew, by grouping."""
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    table = "[" + ", ".join(map(str, clogc(WINDOW))) + "]"
    level = "CASE " + " ".join(f"WHEN kind = '{c[0]}' THEN {most(c[3], WINDOW)}" for c in CLASSES) + " END"
    ranks = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
    # RE2 folds more than ASCII under (?i), so letters are spelled out in both cases
    both = lambda w: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w)
    assign = ASSIGN.replace("(?i:password|passwd|secret|token|api_?key)", "(?:" + "|".join(map(both, ("password", "passwd", "secret", "token", "api_?key"))) + ")")

    def parts(name: str, pattern: str, group: int, least: int) -> str:
        return f"""{name} AS (SELECT doc_id, upto - length(v) AS s, upto AS e, g FROM (
          SELECT doc_id, v, g, sum(length(gap) + length(v)) OVER (PARTITION BY r ORDER BY i) AS upto FROM (
            SELECT r, doc_id, unnest(regexp_extract_all(t, {lit(pattern)}, 0)) AS v, unnest(regexp_extract_all(t, {lit(pattern)}, {group})) AS g,
                   unnest(regexp_split_to_array(t, {lit(pattern)})[1:len(regexp_extract_all(t, {lit(pattern)}, 0))]) AS gap,
                   unnest(range(len(regexp_extract_all(t, {lit(pattern)}, 0)))) AS i
            FROM d)) WHERE length(g) >= {least})"""

    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
{parts('a', assign, 1, ASSIGN_LEAST)},
{parts('k', ACCESS, 0, 1)},
{parts('x', HEX, 0, 1)},
{parts('c0', CANDIDATE, 0, WINDOW)},
base AS (SELECT doc_id, 'assign' AS kind, s, e FROM a UNION ALL SELECT doc_id, 'access', s, e FROM k UNION ALL SELECT doc_id, 'hex', s, e FROM x),
c1 AS (SELECT r, doc_id, s, unnest(regexp_split_to_array(g, {lit(_PIECE)})) AS gap, unnest(list_append(regexp_extract_all(g, {lit(_PIECE)}, 0), '')) AS cut,
        unnest(range(len(regexp_extract_all(g, {lit(_PIECE)}, 0)) + 1)) AS i
       FROM (SELECT row_number() OVER () AS r, doc_id, s, g FROM c0 WHERE NOT regexp_matches(g, {lit(ALLOW)}))),
c2 AS (SELECT doc_id, gap AS g, CAST(s + sum(length(gap) + length(cut)) OVER (PARTITION BY r ORDER BY i) - length(gap) - length(cut) AS BIGINT) AS s FROM c1),
c AS (SELECT row_number() OVER () AS cid, doc_id, s,
        CASE WHEN regexp_matches(g, {lit(CLASSES[0][1])}) THEN 'entropy_hex' WHEN regexp_matches(g, {lit(CLASSES[1][1])}) THEN 'entropy_alnum' ELSE 'entropy_base64' END AS kind,
        CASE WHEN regexp_matches(g, {lit(CLASSES[0][1])}) THEN lower(g) ELSE g END AS g
      FROM c2 WHERE length(g) >= {WINDOW} AND NOT regexp_matches(g, {lit(ALLOW)})),
w AS (SELECT cid, i FROM (SELECT cid, unnest(range(length(g) - {WINDOW - 1})) AS i FROM c)),
ch AS (SELECT w.cid, w.i, substr(c.g, CAST(w.i + j AS BIGINT), 1) AS ch FROM w JOIN c USING (cid), (SELECT unnest(range(1, {WINDOW + 1})) AS j)),
hot AS (SELECT q.cid, q.i FROM (SELECT cid, i, sum({table}[n + 1]) AS total FROM (SELECT cid, i, ch, count(*) AS n FROM ch GROUP BY ALL) GROUP BY cid, i) q
        JOIN c USING (cid) WHERE total <= {level}),
runs AS (SELECT cid, i, sum(new) OVER (PARTITION BY cid ORDER BY i) AS run FROM (
          SELECT cid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY cid ORDER BY i) + {WINDOW} THEN 0 ELSE 1 END AS new FROM hot)),
added AS (SELECT c.doc_id, c.kind, c.s + z.lo AS s, c.s + z.hi + {WINDOW} AS e FROM (SELECT cid, run, min(i) AS lo, max(i) AS hi FROM runs GROUP BY cid, run) z JOIN c USING (cid)),
every AS (SELECT * FROM base UNION ALL
          SELECT * FROM added n WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = n.doc_id AND b.s <= n.s AND n.e <= b.e)),
bs AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, {ranks}) AS j FROM base GROUP BY doc_id),
es AS (SELECT doc_id, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, {ranks}) AS j FROM every GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(bs.j, '')) AS base_sha256, coalesce(es.j, '') AS spans
FROM d LEFT JOIN bs USING (doc_id) LEFT JOIN es USING (doc_id)
"""


ORACLE_SQL = _oracle()
