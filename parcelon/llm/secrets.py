"""Secret scans: a random forest removes the false positives of a broad pattern (DataFrame
operations only; the forest is the one of Spark's own ML library).

Candidates are runs of at least MIN_LENGTH key characters, and of any length those that begin with
a known head and the values that a FOR_WORD names ("password=x", "token: 'x'", "the secret is x").
A named value runs to its closing quote or to white space, unquoted also to one of <>,;|& and so may
hold other characters than keys do; spaces end it. Each has its length,
the rates of its characters and of the transitions between their classes, the number of distinct
characters, the share that dictionary words cover, whether it lies in a path or an address, and
what the words beside it say. The forest is trained from labelled findings: FINDINGS of them are
made by rule (kinds of secrets in their usual places, and the usual false positives: identifiers,
digests of commits, paths, numbers, placeholders, long words), because the tables label none. A
caller with labelled findings of its own gives them instead.

A redaction replaces the characters of each finding where it stands, and nothing else: what another
row, or another place of the same text, holds is judged there.

Defined cases: a null or empty text has no candidates and stays as it is; a text of any length is
scanned whole; repeated rows and rows that share an id, or have none, give their own findings; a
candidate is scored whole however long it is; an empty table gives no rows; further columns stay as
they are, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, numbered, shared_dir, table, text_of, written

MIN_LENGTH = 16
#: Labelled findings that are made for training.
FINDINGS = 8000
TREES, DEPTH, SEED = 30, 8, 9
THRESHOLD = 0.5
REDACTED = "[SECRET]"

#: What may stand around a key, and so is no part of it.
_LEAD = r"^[^\s]*?=(?=[^=])"

#: Words beside a candidate that speak for or against a secret, and words that a
#: key is not made of.
FOR_WORDS = ["password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "credential", "auth", "bearer", "private_key", "key"]
AGAINST_WORDS = ["commit", "sha", "md5", "checksum", "digest", "uuid", "guid", "id", "hash", "version", "build", "phone", "card", "iban", "order", "isbn", "example"]
KNOWN_HEAD = "(?:AKIA|ASIA|ghp_|gho_|xox[bp]-|sk_live_|sk-|AIza|eyJ|glpat-)"
DICTIONARY = ["the", "and", "ing", "ion", "ent", "ter", "example", "test", "user", "data", "name", "file", "path", "home", "index", "page", "http", "www", "com", "net", "org", "html", "image", "config", "local", "version", "this", "that", "with", "from", "your", "key", "value", "sample", "dummy", "placeholder", "changeme", "xxxx", "abcd", "1234", "0000"]
FEATURES = ["length", "digits", "uppers", "lowers", "others", "digit_letter", "case_change", "distinct", "hex", "covered", "vowels", "repeats", "path", "url", "dashes", "for_words", "against_words", "quoted", "assigned", "known_head"]

_RUN, _NAME = "A-Za-z0-9+/_=-", "A-Za-z0-9+/_.-"
_WORD = "(?i:" + "|".join(FOR_WORDS) + ")"
_QUOTE = "[\"'`]"
_SET = rf"{_QUOTE}?\s{{0,3}}[=:]{{1,3}}>?\s{{0,3}}"
_ASSIGNED = rf"[A-Za-z0-9_-]{{0,40}}{_SET}(?:(?i:bearer|basic)\s{{1,3}})?"
#: Told without a sign between; what follows may not be a name that is assigned to itself.
_SAID = rf"s?\s{{1,3}}(?:{_WORD}s?\s{{1,3}}){{0,3}}(?:(?:is|was)\s{{1,3}})?(?![{_NAME}]{{0,80}}?{_WORD}[A-Za-z0-9_-]{{0,40}}{_QUOTE}?\s{{0,3}}[=:])"
_NAMED = rf"[{_NAME}]*?{_WORD}(?:{_ASSIGNED}|{_SAID})"
_VALUE = rf"(?:{_QUOTE}[^\s\"'`]+|[^\s\"'`<>,;|&]+(?<![.:?)\]}}]))"
PATTERN = rf"(?<![{_NAME}]){_NAMED}{_VALUE}|(?<![{_RUN}])(?:{KNOWN_HEAD}[{_RUN}]+|[{_RUN}]{{{MIN_LENGTH},}})"
#: A name before a candidate that is no part of it; "name=value" is one token, as any run is.
_APART = rf"^({_NAMED}{_QUOTE}?)[^\s\"'`]+$"
_JOINED = rf"^[{_NAME}]*?{_WORD}[A-Za-z0-9_-]{{0,40}}=[^\s\"'`=>]"


def _count(token: Column, pattern: str) -> Column:
    return F.regexp_count(token, F.lit(pattern)).cast("double")


def with_features(found: DataFrame) -> DataFrame:
    """Adds FEATURES to columns token, before, after."""
    t, b, a = F.col("token"), F.lower("before"), F.lower("after")
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    low = F.lower(t)
    near = F.concat_ws(" ", b, F.regexp_extract(low, r"^([a-z_-]+)[=:]", 1))
    covered = n - F.length(F.regexp_replace(low, "|".join(DICTIONARY), ""))
    values = {
        "length": n,
        "digits": _count(t, "[0-9]") / n,
        "uppers": _count(t, "[A-Z]") / n,
        "lowers": _count(t, "[a-z]") / n,
        "others": _count(t, "[+/_=-]") / n,
        "digit_letter": _count(t, "[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])") / n,
        "case_change": _count(t, "[a-z](?=[A-Z])|[A-Z](?=[a-z])") / n,
        "distinct": F.size(F.array_distinct(F.split(t, ""))) / F.least(n, F.lit(64.0)),
        "hex": F.when(low.rlike("^[0-9a-f]+$"), 1.0).otherwise(0.0),
        "covered": covered / n,
        "vowels": _count(low, "[aeiou]") / n,
        "repeats": _count(t, r"(.)(?=\1)") / n,
        "path": _count(t, "/") / n,
        "url": F.when(b.rlike(r"(://|www\.|@)\S*$") | a.rlike(r"^\.(com|net|org|html?|png|jpg|js)\b"), 1.0).otherwise(0.0),
        "dashes": F.when(low.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-"), 1.0).otherwise(0.0),
        "for_words": F.when(near.rlike("(" + "|".join(FOR_WORDS) + ")"), 1.0).otherwise(0.0),
        "against_words": F.when(near.rlike(r"\b(" + "|".join(AGAINST_WORDS) + r")\b"), 1.0).otherwise(0.0),
        "quoted": F.when(b.rlike("[\"'`]$"), 1.0).otherwise(0.0),
        "assigned": F.when(b.rlike("[=:]\\s*[\"'`]?$") | low.rlike("^[a-z_]+="), 1.0).otherwise(0.0),
        "known_head": F.when(t.rlike("^" + KNOWN_HEAD), 1.0).otherwise(0.0),
    }
    return found.select("*", *(values[k].cast("double").alias(k) for k in FEATURES))


def candidates(docs: DataFrame, folder: str, text: str = "text", key: str = "doc_id", row: str | None = None) -> DataFrame:
    """Per candidate: row (as `row` numbers them), doc_id, n, start (code points), token, lead (characters of it that are no
    part of the key), before, after; a written table."""
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    rows = docs.select(number.alias("row"), F.col(key).alias("doc_id"), text_of(text).alias("t"))
    rows = rows.where(F.col("t").rlike(PATTERN))
    rows = rows.select("row", "doc_id", F.regexp_extract_all("t", F.lit(PATTERN), 0).alias("tokens"), F.split("t", PATTERN, -1).alias("gaps"))
    name = lambda x: F.when(x.rlike(_JOINED), "").otherwise(F.regexp_extract(x, _APART, 1))
    parts = F.transform("tokens", lambda x: F.struct(name(x).alias("name"), x.alias("found")))
    rows = rows.select("row", "doc_id", "gaps", parts.alias("parts"))

    def piece(p: Column, i: Column) -> Column:
        token, gap = F.substring(p["found"], F.length(p["name"]) + 1, F.length(p["found"])), F.concat(F.get("gaps", i), p["name"])
        lead = F.when(p["name"] == "", F.length(F.regexp_extract(token, _LEAD, 0))).otherwise(0)
        return F.struct(i.alias("n"), token.alias("token"), lead.alias("lead"), F.length(gap).alias("gap"), F.substring(gap, -48, 48).alias("before"), F.substring(F.get("gaps", i + 1), 1, 24).alias("after"))

    pieces = F.transform("parts", piece)
    found = written(rows.select("row", "doc_id", F.explode(pieces).alias("c")).select("row", "doc_id", "c.*"), folder, "candidates")
    order = Window.partitionBy("row").orderBy("n")
    start = F.sum(F.col("gap") + F.length("token")).over(order) - F.length("token")
    return found.withColumn("start", start.cast("long")).drop("gap")


def _pick(words: list[str], seed: Column) -> Column:
    return F.get(F.array(*map(F.lit, words)), F.pmod(seed, F.lit(len(words))).cast("int"))


def labelled_findings(spark: SparkSession, rows: int = FINDINGS) -> DataFrame:
    """token, before, after, label: findings made by rule, the same ones each time."""
    r = spark.range(rows).withColumn("s", F.xxhash64("id", F.lit(77)))
    hexed = F.sha2(F.col("s").cast("string"), 512)
    b64 = F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), F.col("s").cast("string")), 512)))
    u = lambda k: F.xxhash64("s", F.lit(k))
    upper = F.upper(F.translate(F.substring(b64, 5, 40), "+/=01", "QWERT"))
    plain = F.regexp_replace(b64, "[+/=]", "")
    word = F.concat(*(_pick(["tion", "er", "the", "an", "re", "in", "ment", "ique", "schaft", "ado", "ciones", "elle"], u(20 + i)) for i in range(7)))
    # Digits as letters: keys that hold none.
    solid, letters = F.translate(plain, "0123456789", "gTbXqLzRmK"), F.translate(upper, "23456789", "GTBXZLMK")
    brief = _pick(["sunny", "hunter", "garden", "letter", "river", "dragon", "monkey", "winter", "house", "street", "difference", "holder", "point", "board", "Haus", "maison", "casa", "welcome", "summer", "tiger"], u(27))
    filler = _pick(["of the ", "und ", "les ", "de ", "was in ", "to an ", "ist ", "para "], u(1))
    says = _pick([*FOR_WORDS[:12], "Password", "API_KEY", "TOKEN", "aws_secret_access_key"], u(2))
    joint = _pick(["=", " = ", ": ", "=\"", " = \"", ": \"", " ", " is "], u(3))
    told = F.concat(filler, says, joint)
    signed = _pick(["=", " = ", ": ", "=\"", " = \"", ": \""], u(28))
    size = lambda k, low, high: (F.pmod(u(k), F.lit(high - low + 1)) + low).cast("int")
    long = F.substring(F.concat(word, F.lit("ungsplan"), word), F.lit(1), size(34, 16, 36))
    made = [
        (F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), F.when(F.pmod(u(4), F.lit(3)) == 0, told).otherwise(filler), 1),
        (F.substring(hexed, F.lit(1), size(5, 16, 64)), told, 1),
        (F.concat(F.lower(says), F.lit("="), F.substring(hexed, F.lit(1), size(6, 16, 40))), filler, 1),
        (F.substring(b64, F.lit(1), size(7, 20, 64)), told, 1),
        (F.concat(_pick(["ghp_", "sk_live_", "xoxb-", "glpat-"], u(8)), F.substring(plain, F.lit(1), size(9, 20, 40))), filler, 1),
        (F.substring(hexed, F.lit(1), F.lit(40)), F.concat(filler, _pick(["commit ", "sha ", "md5 ", "checksum: ", "digest ", "hash "], u(10))), 0),
        (F.concat_ws("-", F.substring(hexed, 1, 8), F.substring(hexed, 9, 4), F.substring(hexed, 13, 4), F.substring(hexed, 17, 4), F.substring(hexed, 21, 12)), F.concat(filler, _pick(["id ", "uuid ", "", "guid: "], u(11))), 0),
        (F.concat(F.lit("/home/user"), F.substring(hexed, 1, 2), F.lit("/data/"), word, F.substring(hexed, 4, 3)), filler, 0),
        (F.abs(u(12)).cast("string"), F.concat(filler, _pick(["", "card ", "order ", "phone ", "id "], u(13))), 0),
        (F.concat(word, F.pmod(u(14), F.lit(2000)).cast("string")), filler, 0),
        (F.concat(_pick(["example", "your_key_here", "changeme", "xxxxxxxxxxxxxxxx", "placeholder", "AKIAXXXXXXXXEXAMPLE"], u(15)), F.lit("_1234567890")), F.when(F.pmod(u(16), F.lit(2)) == 0, told).otherwise(filler), 0),
        (F.concat(word, F.lit("-"), F.pmod(u(17), F.lit(100000)).cast("string")), F.concat(filler, F.lit("https://www.")), 0),
        (F.concat(F.lit("--------"), F.pmod(u(18), F.lit(10)).cast("string"), F.lit("----------")), filler, 0),
        # Without a digit.
        (F.concat(F.lit("AKIA"), F.substring(letters, 1, 16)), F.when(F.pmod(u(30), F.lit(3)) == 0, told).otherwise(filler), 1),
        (F.substring(solid, F.lit(1), size(31, 16, 40)), told, 1),
        (F.concat(_pick(["ghp_", "sk_live_", "xoxb-", "glpat-"], u(32)), F.substring(solid, F.lit(1), size(33, 8, 40))), filler, 1),
        (F.when(F.pmod(u(50), F.lit(4)) == 0, F.upper(long)).when(F.pmod(u(50), F.lit(4)) == 1, F.initcap(long)).otherwise(long), filler, 0),
        (F.concat(F.lit("/"), brief, F.lit("/"), word, F.lit("/"), brief), filler, 0),
        (F.concat(brief, F.lit("-"), word, F.lit("-"), brief), filler, 0),
        (F.concat(_pick(["aws_secret_access_key", "private_key_of_the_user", "get_access_token_from", "--password-from-file", "AuthenticationToken"], u(35)), F.lit("_"), brief), filler, 0),
        (F.repeat(_pick(["-", "=", "_", "/", "x", "-="], u(36)), size(37, 16, 60)), filler, 0),
        # Shorter than MIN_LENGTH, named by a word: keys, then words that only stand there.
        (F.substring(plain, F.lit(1), size(38, 6, 15)), told, 1),
        (F.substring(solid, F.lit(1), size(39, 8, 15)), F.concat(filler, says, signed), 1),
        (F.concat(brief, F.pmod(u(40), F.lit(10000)).cast("string"), _pick(["", "!", "#", "$x"], u(41))), told, 1),
        (F.concat(F.lower(says), F.lit("="), F.when(F.pmod(u(42), F.lit(2)) == 0, brief).otherwise(F.substring(plain, F.lit(1), size(43, 4, 12)))), filler, 1),
        (brief, F.concat(filler, says, _pick(['="', '= "', ' = "', "='"], u(44))), 1),
        (brief, F.concat(filler, says, _pick([" ", " is ", ": "], u(45))), 0),
        (_pick(["the", "of", "a", "in", "to", "for", "and", "und", "is", "or", "must", "required", "null", "None", "true", "string", "value", "example", "changeme", "xxxx", "****", "...", "-"], u(46)), told, 0),
        (F.concat(_pick(["get_", "self.", "os.environ[", "config.", "$"], u(47)), brief, _pick(["()", "", "(x)"], u(48))), F.concat(filler, says, _pick(["=", " = ", ": "], u(49))), 0),
    ]
    kind = F.pmod(u(0), F.lit(len(made)))
    choose = lambda place: reduce(lambda rest, i: F.when(kind == i, made[i][place]).otherwise(rest), range(len(made)), F.lit(""))
    label = reduce(lambda rest, i: F.when(kind == i, F.lit(float(made[i][2]))).otherwise(rest), range(len(made)), F.lit(0.0))
    return r.select(choose(0).alias("token"), choose(1).alias("before"), _pick([" of", ". ", "\" in", "", ", ", ".html", " und"], u(19)).alias("after"), label.alias("label"))


def assembled(found: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(found))


def fit(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> RandomForestClassificationModel:
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=SEED, subsamplingRate=0.8)
    return forest.fit(assembled(findings).select("features", "label"))


def scored(docs: DataFrame, folder: str | None = None, findings: DataFrame | None = None, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id", row: str | None = None) -> DataFrame:
    """Per candidate: row, doc_id, n, start, token, lead, score, is_secret."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    model = fit(labelled_findings(spark) if findings is None else findings)
    found = model.transform(assembled(candidates(docs, folder, text, key, row)))
    return found.select("row", "doc_id", "n", "start", "token", "lead", vector_to_array("probability")[1].alias("score")).withColumn("is_secret", F.col("score") >= threshold)


def scan(docs: DataFrame, folder: str | None = None, findings: DataFrame | None = None, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per candidate: doc_id, n, start, token, score, is_secret."""
    return scored(docs, folder, findings, threshold, text, key).drop("row", "lead")


def replaced(text: Column, spans: Column) -> Column:
    """The text with REDACTED in place of spans: an array of structs of start and end (code points
    from 0), which do not overlap."""
    ordered = F.array_sort(spans)
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(ordered, lambda s: s["end"]))
    ends = F.concat(F.transform(ordered, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    gaps = F.zip_with(begins, ends, lambda b, e: F.substring(text, (b + 1).cast("int"), (e - b).cast("int")))
    return F.array_join(gaps, REDACTED)


def redact(docs: DataFrame, folder: str | None = None, findings: DataFrame | None = None, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents with each secret replaced where it was found; n_chars follows the text."""
    folder = folder or shared_dir(docs.sparkSession)
    row, owner, held, grown = (free_name(docs, n) for n in ("row", "owner", "spans", "grown"))
    rows = numbered(docs, folder, row)
    found = scored(rows, folder, findings, threshold, text, key, row).where("is_secret")
    span = F.struct((F.col("start") + F.col("lead")).alias("start"), (F.col("start") + F.length("token")).alias("end"))
    more = F.sum(F.lit(len(REDACTED)) - (F.length("token") - F.col("lead")))
    spans = written(found.groupBy(F.col("row").alias(owner)).agg(F.collect_list(span).alias(held), more.alias(grown)), folder, "spans")
    # The owners grow with the input: a merge join at every size, never a broadcast.
    joined = rows.join(spans.hint("merge"), F.col(row) == F.col(owner), "left")
    clean = F.col(held).isNull()
    changed = {text: F.when(clean, F.col(text)).otherwise(replaced(F.col(text), F.col(held)))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(clean, F.col("n_chars")).otherwise((F.length(F.col(text)) + F.col(grown)).cast(docs.schema["n_chars"].dataType))
    return joined.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n", "start", F.length("token").cast("long").alias("length"), F.sha2("token", 256).alias("token_sha256"), "score", "is_secret")
