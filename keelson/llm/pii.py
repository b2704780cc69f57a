"""Personal data: base patterns, and bootstrapped contextual extraction.

Base entities (email, ip, card, phone) are seeds.  Their lexical patterns are
the two words before them; a pattern is scored by what share of *all* its
occurrences in the corpus is followed by a trusted entity of the kind, an
instance by the noisy-or of its patterns, in turn, for a few rounds.  Number-like
or email-like texts that no base pattern takes are trusted where a pattern of high
confidence and wide support introduces them.  Trusted values give patterns in
their turn, for a few hops, and are reported (``ctx_<kind>``) wherever they
stand with a context.

Only DataFrame functions are used.  Positions come from marking: every match is
wrapped in two control characters (which are first replaced in the text, one
for one), and the marked text is split.

Contract for odd input: a null or empty text has no spans; repeated rows have
equal spans; a pattern's support counts distinct values, so copies do not lend
it confidence; an empty table gives an empty table.  Only the named columns are
read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

KINDS = ("email", "ip", "card", "phone")
OPEN, CLOSE, OTHER = "\u0001", "\u0002", "\u0003"
SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"

# The base patterns, with possessive repeats and run starts that find the same matches in linear time:
# a match can only begin at the start of a run of its first class, or where the match before it ended.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
# (a look-behind stands after the first character, so that most places fail on one class test)
IP = r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}"
CARD = r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
# What a pattern may discover: grouped digits without a plus, and spelled-out addresses.
NUMBER_LIKE = r"(?:\([0-9](?<![\w+.,:/-]\([0-9])|[0-9](?<![\w+.,:/(-][0-9]))(?:[ ().-]{0,2}[0-9]){5,18}+(?![\w.-]*\w)"
# (a bare "at" or "dot" counts as well as a bracketed one; a dot before a space and a capital ends a
# sentence: it joins a domain only as its first dot behind a bracketed "at")
_LABEL = "[A-Za-z0-9-]++"
_DOT = r" ?(?:[(\[]dot[)\]]| dot |\.(?! [A-Z])) ?"
EMAIL_LIKE = (rf"(?<!\S){_LOCAL}{{1,64}}+(?: ?(?:[(\[]at[)\]]| at )+ ?{_LABEL}{_DOT}{_LABEL}"
              rf"| ?[(\[]at[)\]] ?{_LABEL}\. {_LABEL})(?:{_DOT}{_LABEL}){{0,3}}+")


@dataclass(frozen=True)
class Bootstrap:
    """Limits of the bootstrap; they bound what is reported, not what is counted."""

    rounds: int = 3
    hops: int = 3               # times that trusted values may give further patterns
    support: int = 3            # distinct seed values behind a pattern
    pattern_least: float = 0.5  # share of a pattern's occurrences followed by trusted entities
    instance_least: float = 0.5
    window: int = 100           # characters before an entity that may hold its two context words
    broadcast_rows: int = 1_000_000   # patterns (8 bytes each) up to which they are broadcast


def luhn(digits: Column) -> Column:
    """Luhn check of a digit string: from the right, every second digit doubled."""
    pairs = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(d == "", 0).otherwise(
        F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))
        .otherwise(d.cast("int"))))
    return F.aggregate(pairs, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


ACCEPTS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
    "card": lambda m: luhn(_digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
    "number_like": lambda m: F.length(_digits(m)).between(6, 19),
    "email_like": lambda m: F.lit(True),
}
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "number_like": NUMBER_LIKE, "email_like": EMAIL_LIKE}
# a text without a match of these has none of the kind, which saves most texts a pass
NEEDS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+", "number_like": "[0-9]",
         "email_like": rf"at(?:[)\]]|  ?{_LABEL}{_DOT}[A-Za-z0-9-])"}


def _clean(text: Column) -> Column:
    """The text without nulls and control marks (replaced one for one)."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(f"[{OPEN}{CLOSE}]"), F.translate(text, OPEN + CLOSE, OTHER * 2)).otherwise(text)


def _marked(text: Column, kind: str) -> Column:
    parts = F.split(F.regexp_replace(text, PATTERNS[kind], f"{OPEN}$0{CLOSE}"), OPEN)
    return F.when(F.col(f"may_{kind}"), parts).otherwise(F.array(text))


def _spans(parts: Column, kind: str) -> Column:
    """Accepted matches with their places, from a marked and split text."""
    def step(acc, p):
        value = F.substring_index(p, CLOSE, 1)
        span = F.struct(F.lit(kind).alias("kind"), acc["at"].alias("start"),
                        (acc["at"] + F.length(value)).alias("end"), value.alias("value"))
        return F.struct((acc["at"] + F.length(p) - 1).alias("at"),
                        F.when(ACCEPTS[kind](value), F.concat(acc["found"], F.array(span)))
                        .otherwise(acc["found"]).alias("found"))

    start = F.struct(F.length(F.get(parts, F.lit(0))).cast("bigint").alias("at"),
                     F.expr(f"cast(array() as {SPAN})").alias("found"))
    return F.when(F.size(parts) > 1, F.aggregate(F.slice(parts, 2, F.size(parts)), start, step)["found"]) \
        .otherwise(F.expr(f"cast(array() as {SPAN})"))


def _context(text: Column, start: Column, window: int) -> Column:
    """Hash of the two lower-cased words before a place that white space precedes, else null."""
    from_ = F.greatest(start - window, F.lit(0))
    left = F.lower(F.substring(text, (from_ + 1).cast("int"), (start - from_).cast("int")))
    words = F.split(F.rtrim(F.regexp_replace(left, r"\s+", " ")), " ")
    n = F.size(words)
    whole = (n >= 3) | ((n == 2) & (from_ == 0))       # the earlier word is not cut by the window
    return F.when(left.rlike(r"\s$") & whole,
                  F.xxhash64(F.get(words, n - 2), F.get(words, n - 1)))


def entities(df: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(row, id, base, candidates): spans with the hash of their context; one stored row per input row."""
    rows = df.select(F.col(id_col).alias("id"), _clean(F.col(text_col)).alias("text"))
    tests = {test: F.col("text").rlike(test) for test in NEEDS.values()}
    rows = rows.select("*", *[tests[NEEDS[kind]].alias(f"may_{kind}") for kind in PATTERNS])
    rows = rows.select("id", "text", *[_marked(F.col("text"), kind).alias(f"p_{kind}") for kind in PATTERNS])
    rows = rows.select("id", "text", *[_spans(F.col(f"p_{kind}"), kind).alias(kind) for kind in PATTERNS])

    def with_context(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            F.when(s["kind"].isin("email", "email_like"), F.lower(s["value"])).otherwise(_digits(s["value"])).alias("value"),
            _context(F.col("text"), s["start"], window).alias("context")))

    base = F.concat(*KINDS)
    other = F.filter(F.concat("number_like", "email_like"), lambda c: ~F.exists(
        F.col("base"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return rows.withColumn("base", base).withColumn("other", other).select(
        F.monotonically_increasing_id().alias("row"), "id", with_context(F.col("base")).alias("base"),
        F.filter(with_context(F.col("other")), lambda s: s["context"].isNotNull()).alias("candidates"))


def occurrences(df: DataFrame, text_col: str, patterns: DataFrame, limits: Bootstrap) -> DataFrame:
    """(context, seen): how often the two words of each given pattern follow each other in all texts."""
    words = df.select(F.split(F.lower(_clean(F.col(text_col))), r"\s+").alias("w")) \
        .filter(F.size("w") >= 2)
    pairs = words.select(F.explode(F.transform(
        F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1)))).alias("context"))
    wanted = patterns.select("context").distinct()
    small = wanted.limit(limits.broadcast_rows + 1).count() <= limits.broadcast_rows
    wanted = F.broadcast(wanted) if small else wanted       # else a shuffle join on the pair's hash
    return stored(pairs.join(wanted, "context", "left_semi").groupBy("context").agg(F.count("*").alias("seen")), "pii-seen")


def bootstrap(edges: DataFrame, seen: DataFrame, limits: Bootstrap) -> DataFrame:
    """(context, kind, value) of instances that confident patterns introduce.

    ``edges``: (context, kind, value, seed, n); patterns and instances score each other in rounds.
    """
    edges = stored(edges.join(seen, "context"), "pii-graph")
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    for _ in range(limits.rounds):
        patterns = scored.groupBy("context", "kind").agg(
            (F.sum(F.col("score") * F.col("n")) / F.first("seen")).alias("confidence"),
            F.count_distinct(F.when(F.col("seed"), F.col("value"))).alias("support")) \
            .withColumn("confidence", F.when(F.col("support") >= limits.support, F.least("confidence", F.lit(1.0)))
                        .otherwise(0.0))
        backed = edges.join(patterns, ["context", "kind"])
        instances = backed.groupBy("kind", "value").agg(
            F.max("seed").alias("known"),
            (1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("belief"))
        scored = stored(backed.join(instances, ["kind", "value"]).select(
            "context", "kind", "value", "seed", "n", "seen", "confidence",
            F.when(F.col("known"), 1.0).otherwise(F.col("belief")).alias("score")), "pii-round")
    return scored.filter(~F.col("seed") & (F.col("confidence") >= limits.pattern_least)
                         & (F.col("score") >= limits.instance_least)).select("context", "kind", "value").distinct()


def _fits(shape: Column, value: Column, kind: Column) -> Column:
    """What a discovered text must look like to be of a kind."""
    n = F.length(value)
    return F.when(shape == "email_like", kind == "email") \
        .otherwise(((kind == "phone") & n.between(7, 15)) | ((kind == "card") & n.between(12, 19)))


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             limits: Bootstrap | None = None) -> DataFrame:
    """(id, spans: array<struct<kind,start,end>>): base spans by kind and start, then discovered ones likewise."""
    limits = limits or Bootstrap()
    found = stored(entities(df, id_col, text_col, limits.window), "pii-entities")
    spans = found.select(F.explode("base").alias("s")).select("s.*").filter("context is not null")
    seeds = stored(spans.groupBy("context", "kind", "value").agg(F.count("*").alias("n")), "pii-seeds")
    candidates = found.select("row", F.explode("candidates").alias("s")).select("row", "s.*") \
        .withColumnRenamed("kind", "shape").withColumn("kind", F.explode(F.array(*map(F.lit, KINDS)))) \
        .filter(_fits(F.col("shape"), F.col("value"), F.col("kind")))
    candidates = stored(candidates, "pii-candidates")
    instances = stored(candidates.groupBy("context", "kind", "value").agg(F.count("*").alias("n")), "pii-instances")
    # each hop: what is trusted so far gives the patterns, and these trust further values
    trusted = seeds.select("kind", "value").limit(0)
    for _ in range(limits.hops):
        known = stored(seeds.unionByName(instances.join(trusted, ["kind", "value"], "left_semi"))
                       .groupBy("context", "kind", "value").agg(F.sum("n").alias("n")), "pii-known")
        patterns = known.groupBy("context", "kind").agg(F.count("*").alias("support")) \
            .filter(F.col("support") >= limits.support).select("context", "kind")
        open_ = stored(instances.join(trusted, ["kind", "value"], "left_anti")
                       .join(patterns, ["context", "kind"], "left_semi"), "pii-open")
        # a pattern that introduces nothing new can discover nothing
        useful = open_.select("context", "kind").distinct()
        edges = stored(known.join(useful, ["context", "kind"], "left_semi").withColumn("seed", F.lit(True))
                       .unionByName(open_.withColumn("seed", F.lit(False))), "pii-edges")
        if edges.isEmpty():
            break
        new = bootstrap(edges, occurrences(df, text_col, edges, limits), limits).select("kind", "value")
        more = stored(trusted.unionByName(new).distinct(), "pii-trusted")
        if more.count() == trusted.count():
            break
        trusted = more
    new = candidates.join(trusted, ["kind", "value"], "left_semi").groupBy("row").agg(
        F.sort_array(F.collect_set(F.struct(F.concat(F.lit("ctx_"), "kind").alias("kind"), "start", "end"))).alias("new"))
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint>>)")
    return found.join(new, "row", "left").select(F.col("id").alias(id_col),
                                                 F.concat(plain, F.coalesce("new", none)).alias("spans"))
