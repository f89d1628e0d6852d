"""Secret scan with multipart credential linking. DataFrame operations only.

Base spans (assignments of secrets, access keys, long hex strings) are strong by themselves. Weak
candidates - account names, opaque strings, endpoints - mean nothing alone; they are reported only
when complementary parts stand near them: within WINDOW code points of the same text an access
identifier needs a secret, a secret needs an access identifier, an endpoint needs both. The parts
meet in an interval join on (row, window), in which a span meets only its own and adjacent windows.

Positions come from splitting at the same pattern that extracts the matches: what stands between
matches, and the matches themselves, add up to code point offsets. They are added up by chunks, and
redaction works on blocks of a text, so that a text with very many matches takes time in proportion.

Defined results: a null text counts as empty and has no span; it stays null in redact(). Every input
row gives one output row, repeated rows too. redact() keeps all columns, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize, named

#: The patterns of the base kinds, in order. For hex strings and access keys the
#: least length stands in the pattern, which finds the same runs.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_SECRET = 6

#: Weak candidates: kind, order behind the base kinds, role, pattern.
WEAK = (
    ("account", 3, "access", r"""(?i:access_?key_?id|client_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}"""),
    ("opaque", 4, "secret", r"[A-Za-z0-9+/_-]{20,}"),
    ("endpoint", 5, "endpoint", r"""(?:https?|ftp|postgres(?:ql)?|mysql|redis|amqp|mongodb)://[^\s"'<>]+"""),
)
#: An opaque string counts only with a digit, a capital and a small letter.
MIXED = ("opaque", ("[0-9]", "[A-Z]", "[a-z]"))
WINDOW = 256
#: Matches whose offsets are added up at a time, and code points of a block in redaction.
CHUNK, BLOCK = 256, 4096

SPAN = "array<struct<start:int,ord:int,end:int,kind:string,role:string>>"


def _placed(parts: Column) -> Column:
    """Starts and ends from the lengths (b between, m matched) of consecutive matches: within chunks first, then over chunks."""
    kind = "array<struct<start:int,end:int,g:int>>"

    def add(held: Column, x: Column) -> Column:
        span = F.struct((held["at"] + x["b"]).alias("start"), (held["at"] + x["b"] + x["m"]).alias("end"), x["g"].alias("g"))
        return F.struct((held["at"] + x["b"] + x["m"]).alias("at"), F.array_append(held["out"], span).alias("out"))

    def moved(held: Column, chunk: Column) -> Column:
        spans = F.transform(chunk["out"], lambda y: F.struct((y["start"] + held["at"]).alias("start"), (y["end"] + held["at"]).alias("end"), y["g"].alias("g")))
        return F.struct((held["at"] + chunk["at"]).alias("at"), F.array_append(held["out"], spans).alias("out"))

    def whole(p: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / CHUNK).cast("int")), lambda i: F.slice(p, i * CHUNK + 1, F.lit(CHUNK)))
        within = F.transform(chunks, lambda c: F.aggregate(c, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), add))
        return F.flatten(F.aggregate(within, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")), moved)["out"])

    return F.transform(F.array(parts), whole)[0]  # the lambda's variable: parts are made once


def _spans(text: Column, pattern: str, kind: str, order: int, role: str, group: tuple[int, int] | None = None) -> Column:
    """Leftmost non-overlapping matches of pattern as spans in code points; group: (number, least length)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    size = F.regexp_extract_all(text, F.lit(pattern), F.lit(group[0])) if group else found
    mixed = lambda m: reduce(lambda a, b: a & b, [m.rlike(c) for c in MIXED[1]]) if kind == MIXED[0] else F.lit(True)
    parts = F.transform(
        F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("b"), found.alias("m"), size.alias("g")),
        lambda x: F.struct(F.length(x["b"]).alias("b"), F.length(x["m"]).alias("m"), F.when(mixed(x["m"]), F.length(x["g"])).otherwise(-1).alias("g")),
    )
    placed = _placed(parts)
    if group or kind == MIXED[0]:
        placed = F.filter(placed, lambda x: x["g"] >= (group[1] if group else 0))
    spans = F.transform(placed, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("ord"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(role).alias("role")))
    return F.when(F.coalesce(text, F.lit("")).rlike(pattern), spans).otherwise(F.array()).cast(SPAN)


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """rid (a number of the row), row (the columns to keep), base and weak (arrays of spans), as a written table."""
    text = F.col("text")
    base = F.array_sort(F.concat(_spans(text, ASSIGN, "assign", 0, "secret", (2, MIN_SECRET)), _spans(text, ACCESS, "access", 1, "access"), _spans(text, HEX, "hex", 2, "secret")))
    weak = F.concat(*[_spans(text, pattern, kind, order, role) for kind, order, role, pattern in WEAK])
    row = F.struct(*[named(c) for c in keep])
    return materialize(docs.select(F.monotonically_increasing_id().alias("rid"), row.alias("row"), base.alias("base"), weak.alias("weak")), "candidates")


def link(found: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """rid, a: the weak spans of found(rid, base, weak) whose complementary parts stand near.

    Spans that overlap a base span say nothing new and are left out.
    """
    some = found.filter(F.size("weak") > 0)
    ours = some.select("rid", F.explode("weak").alias("a")).select(
        "rid", "a", F.explode(F.sequence(F.floor((F.col("a.start") - window) / window), F.floor((F.col("a.end") + window) / window))).alias("bucket")
    )
    theirs = some.select("rid", F.explode(F.concat("base", "weak")).alias("b")).select(
        "rid", "b", F.explode(F.sequence(F.floor(F.col("b.start") / window), F.floor((F.col("b.end") - 1) / window))).alias("bucket")
    )
    hides = (F.col("b.ord") < WEAK[0][1]) & (F.col("b.start") < F.col("a.end")) & (F.col("a.start") < F.col("b.end"))
    helps = (
        (F.col("a.role") != F.col("b.role")) & (F.col("b.role") != "endpoint")
        & (F.col("b.start") <= F.col("a.end") + window) & (F.col("a.start") <= F.col("b.end") + window)
    )
    met = ours.join(theirs, ["rid", "bucket"]).filter(hides | helps).groupBy("rid", "a").agg(
        F.bool_or(hides).alias("hidden"), F.bool_or(helps & (F.col("b.role") == "access")).alias("has_access"), F.bool_or(helps & (F.col("b.role") == "secret")).alias("has_secret")
    )
    whole = F.when(F.col("a.role") == "access", F.col("has_secret")).when(F.col("a.role") == "secret", F.col("has_access")).otherwise(F.col("has_access") & F.col("has_secret"))
    return met.filter(~F.col("hidden") & whole).select("rid", "a")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """docs' doc_id with base and all (base and linked) spans, ordered by start, then kind."""
    found = candidates(docs, ["doc_id"]).select("rid", "row.doc_id", "base", "weak")
    linked = link(found, window=window).groupBy("rid").agg(F.collect_list("a").alias("linked"))
    return found.join(linked, "rid", "left").select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(SPAN)))).alias("spans"))


def redact(docs: DataFrame, *, mark: str = "[SECRET]", window: int = WINDOW) -> DataFrame:
    """docs with every reported span of text replaced by mark (and n_chars set anew); overlapping spans count as one.

    Rows without a candidate pass by. The texts of the others are cut into blocks, each with its part
    of the spans; a mark goes where a span begins.
    """
    found = candidates(docs, docs.columns)
    bare = (F.size("base") == 0) & (F.size("weak") == 0)
    some = found.filter(~bare)
    spans = some.select("rid", F.explode("base").alias("a")).unionByName(link(some, window=window))
    parts = spans.select("rid", "a", F.explode(F.sequence(F.floor(F.col("a.start") / BLOCK), F.floor((F.col("a.end") - 1) / BLOCK))).alias("block"))
    first = F.col("block") * BLOCK
    clipped = F.struct(F.greatest(F.col("a.start") - first, F.lit(0)).alias("start"), (F.col("a.end") - first).alias("end"), (F.col("a.start") >= first).alias("begins"))
    cuts = parts.groupBy("rid", "block").agg(F.array_sort(F.collect_list(clipped)).alias("cuts"))
    blocks = some.join(spans.select("rid").distinct(), "rid", "left_semi").select("rid", F.posexplode(F.regexp_extract_all("row.text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))).alias("block", "piece"))
    out = F.aggregate(
        F.coalesce("cuts", F.array().cast("array<struct<start:bigint,end:bigint,begins:boolean>>")),
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(
            F.greatest(a["at"], x["end"]).alias("at"),
            F.when(~x["begins"] | (x["start"] < a["at"]), a["out"]).otherwise(F.concat(a["out"], F.substr("piece", (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit(mark))).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substr("piece", (a["at"] + 1).cast("int"))),
    )
    told = blocks.join(cuts, ["rid", "block"], "left").select("rid", F.struct("block", out.alias("out")).alias("o"))
    clean = told.groupBy("rid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o")), lambda o: o["out"]), "").alias("clean"))
    row = F.col("row").withField("text", F.coalesce("clean", "row.text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.coalesce(F.length("clean").cast(docs.schema["n_chars"].dataType), F.col("row.n_chars")))
    changed = some.join(clean, "rid", "left").select(row.alias("row"))
    return found.filter(bare).select("row").unionByName(changed).select("row.*")


def _oracle_kind(kind: str, order: int, role: str, pattern: str, group: tuple[int, int] | None) -> str:
    quoted = pattern.replace("'", "''")
    size = f"regexp_extract_all(text, '{quoted}', {group[0] if group else 0})"
    test = f"length(g[i]) >= {group[1]}" if group else " AND ".join(f"regexp_matches(m[i], '{c}')" for c in MIXED[1]) if kind == MIXED[0] else "TRUE"
    return f"""SELECT doc_id, '{kind}' AS kind, {order} AS ord, '{role}' AS role,
  (coalesce(list_sum([length(x) for x in b[1:i]]), 0) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0))::BIGINT AS s,
  (coalesce(list_sum([length(x) for x in b[1:i]]), 0) + coalesce(list_sum([length(x) for x in m[1:i]]), 0))::BIGINT AS e
FROM (SELECT doc_id, m, b, g, unnest(range(1, len(m) + 1)) AS i FROM (
  SELECT doc_id, regexp_extract_all(text, '{quoted}') AS m, string_split_regex(text, '{quoted}') AS b, {size} AS g FROM documents WHERE text IS NOT NULL)) WHERE {test}"""


#: The same in DuckDB SQL, for the query's columns.
ORACLE = (
    "WITH spans AS (\n"
    + "\nUNION ALL ".join(
        [_oracle_kind("assign", 0, "secret", ASSIGN, (2, MIN_SECRET)), _oracle_kind("access", 1, "access", ACCESS, None), _oracle_kind("hex", 2, "secret", HEX, None)]
        + [_oracle_kind(kind, order, role, pattern, None) for kind, order, role, pattern in WEAK]
    )
    + f"""),
alone AS (SELECT * FROM spans a WHERE ord > 2 AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.doc_id = a.doc_id AND b.ord <= 2 AND b.s < a.e AND a.s < b.e)),
met AS (SELECT a.*, bool_or(b.role = 'access') AS has_access, bool_or(b.role = 'secret') AS has_secret FROM alone a JOIN spans b
  ON a.doc_id = b.doc_id AND a.role <> b.role AND b.role <> 'endpoint' AND b.s <= a.e + {WINDOW} AND a.s <= b.e + {WINDOW} GROUP BY ALL),
shown AS (SELECT doc_id, kind, ord, s, e FROM spans WHERE ord <= 2 UNION ALL
  SELECT doc_id, kind, ord, s, e FROM met WHERE CASE role WHEN 'access' THEN has_secret WHEN 'secret' THEN has_access ELSE has_access AND has_secret END)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord, e) FILTER (ord <= 2), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord, e), '') AS spans
FROM documents d LEFT JOIN shown USING (doc_id) GROUP BY d.doc_id"""
)
