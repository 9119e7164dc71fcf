"""Secret scans: patterns propose findings, a random forest removes false positives. DataFrame operations alone.

Candidates are known formats, values assigned to telling names, private key blocks, passwords in addresses and long
mixed tokens. Features are the candidate's length, its character classes and transitions, the share of it that
dictionary words cover, whether it is part of a path or address, and the neighbouring words. The forest learns from
labelled findings; the tables have none, so they are written here from templates of real formats and of the usual
false positives (digests, identifiers, paths, placeholders, numbers), filled with hashes of a row number.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.llm.common import materialize

#: Labelled findings that training takes; forest; characters of context on either side.
FINDINGS, TREES, DEPTH, SEED, CONTEXT = 6000, 24, 6, 5, 48
KEEP, MASK = 0.5, "[SECRET]"

_NAMES = r"(?:api[_-]?key|access[_-]?key|private[_-]?key|secret(?:[_-]?key)?|auth(?:[_-]?token)?|token|passw(?:or)?d|passphrase|pwd|credentials?|bearer)"
#: Formats that end where their characters do; quantifiers are possessive, so that long texts cost no backtracking.
_KNOWN = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:\s*+(?:Proc-Type|DEK-Info):[^\n]*+\n){0,4}+[^-]++-----END [A-Z ]{0,30}PRIVATE KEY-----",
    r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{20,}+",
    r"(?<![A-Za-z0-9])(?:sk|pk|rk)[_-](?:live|test|proj)?[_-]?[A-Za-z0-9]{16,}+",
    r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+",
    r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])",
    r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{6,}+",
)
#: One alternation, longest forms first; the candidate may carry its name, which is split off afterwards.
PATTERN = "|".join((
    *_KNOWN,
    r"(?<=://)[A-Za-z0-9._%+-]++:[^\s@/:]{4,}+(?=@)",
    r"(?i:" + _NAMES + r")[\"']?[ \t]{0,3}(?:=>|:=|[:=])[ \t]{0,3}[\"']?(?:(?:" + "|".join(_KNOWN) + r")(?![^\s\"'<>,;)\]}])|[^\s\"'<>,;]{6,}+)",
    r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*+[0-9])(?=[0-9+/_.=-]*+[A-Za-z])[A-Za-z0-9+/_.=-]{20,}+",
))
_VALUE = r"^(?i:" + _NAMES + r")[\"']?[ \t]{0,3}(?:=>|:=|[:=])[ \t]{0,3}[\"']?"
_WORDS = r"(?:example|sample|placeholder|changeme|change|insert|replace|dummy|fake|your|here|test|none|null|true|false|undefined|password|secret|token|key|user|admin|name|value|string|config|version|release|build|index|image|static|assets|content|data|file|path|home|html|http|www|com|lib|src|main|module|function|default|thread|worker|session|request)"
_TELLING = r"(?i)" + _NAMES
_DIGEST = r"(?i)(?:sha-?\d*|md5|digest|checksum|commit|revision|etag|uuid|guid|blob|hash|fingerprint|isbn|serial|order|invoice)"
_MOCK = r"(?i)(?:example|sample|placeholder|dummy|fake|changeme|e\.g\.|for instance|test)"

FEATURES = ("length", "digits", "upper", "lower", "symbols", "transitions", "distinct", "hexadecimal", "coverage", "path", "assigned", "quoted", "telling", "digest", "mock", "known", "repeats")


def _count(text, pattern: str) -> F.Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")


def features(c: DataFrame) -> DataFrame:
    """c (secret, found, before, after) with FEATURES as doubles."""
    s, n = F.col("secret"), F.greatest(F.length("secret"), F.lit(1)).cast("double")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[0-9]", "0"), "[A-Z]", "A"), "[a-z]", "a"), "[^0-9A-Za-z]", "-")
    runs = F.length(F.regexp_replace(classes, r"(.)\1+", "$1")).cast("double")
    near = F.concat(F.right(F.col("before"), F.lit(24)), F.lit(" "), F.col("found"))
    flag = lambda x: x.cast("double")
    values = {
        "length": n, "digits": _count(s, "[0-9]") / n, "upper": _count(s, "[A-Z]") / n, "lower": _count(s, "[a-z]") / n,
        "symbols": _count(s, "[^A-Za-z0-9]") / n, "transitions": runs / n,
        "distinct": F.size(F.array_distinct(F.split(F.lower(s), ""))).cast("double") / F.least(n, F.lit(36.0)),
        "hexadecimal": flag(s.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")), "coverage": _count(F.lower(s), _WORDS) / n,
        "path": flag(s.rlike(r"^[./~]|/.*/|\.(?:[a-z]{2,4}|html|json)$|^[0-9a-f]{8}-[0-9a-f]{4}-") | F.col("before").rlike(r"(?:https?://|www\.)\S*$|[/\\]$")),
        "assigned": flag(F.col("found").rlike(_VALUE) | F.col("before").rlike(r"[:=]\s*[\"']?$")), "quoted": flag(F.col("after").rlike(r"^[\"']")),
        "telling": flag(near.rlike(_TELLING)), "digest": flag(near.rlike(_DIGEST)),
        "mock": flag(F.concat_ws(" ", "before", "found", "after").rlike(_MOCK)),
        "known": flag(s.rlike(r"^(?:-----BEGIN|AKIA|ASIA|gh[pousr]_|xox[abprs]-|AIza|eyJ|sk[_-]|rk[_-])") | F.col("after").rlike("^@")),
        "repeats": _count(s, r"(.)\1{2,}|\*+|x{3,}") / n,
    }
    return c.select("*", *[values[k].alias(k) for k in FEATURES])


#: (label, before, name that belongs to the finding, secret, after). {h8}: hexadecimal, {b9}: letters and digits, {d4}: digits,
#: {w}: a plain word, {n}: a telling name.
_FORMS = [
    (1, "", '{n} = "', "{h40}", '" '), (1, "", "{n}=", "{b32}", " "), (1, "", "{n}: ", "{b24}", "\n"), (1, "", '{n} = "', "{h32}", '"'), (1, "key ", "", "AKIA{H16}", " "),
    (1, "", "", "ghp_{b36}", " "), (1, "", "", "sk_live_{b24}", " "), (1, "postgres://", "", "admin:{b12}", "@db.host"), (1, "Authorization ", "bearer: ", "{b40}", " "),
    (1, "", "", "eyJ{b20}.{b30}.{b27}", " "), (1, "", "{n}='", "{b9}!{d2}", "'"),
    (0, "commit ", "", "{h40}", " "), (0, "sha256:", "", "{h64}", " "), (0, "md5 checksum = ", "", "{h32}", " "), (0, "id ", "", "{h8}-{h4}-{h4}-{h4}-{h12}", " "),
    (0, "see ", "", "/home/user{d2}/lib/data/{h8}.json", " "), (0, "https://www.example.com/static/", "", "{h16}-main-{d6}.html", " "), (0, "set ", "{n} = ", "your-token-here", " "),
    (0, "", "{n}: ", "<insert_password>", " "), (0, "", "{n}=", "xxxxxxxxxxxxxxxx", " "), (0, "for example ", '{n}="', "changeme123", '"'), (0, "the ", "", "release-version-{d4}-build", " "),
    (0, "mail ", "", "{w}.{d2}_mail{d1}.example.com", " "), (0, "", "{n}: ", "{w}{w}{w}", " "), (0, "call ", "{n}=", "request.session.{w}_value", " "),
    (0, "order ", "", "INV-{d12}-{d6}-A", " "), (0, "etag ", "", "{h40}", " "), (0, "by ", "", "thread_worker_{d2}_main_module", " "),
]
_PLAIN = ("the", "of", "deploy", "notes", "see", "with", "server", "und", "pour", "para", "value", "a")
_NAMED = ("token", "password", "api_key", "secret", "passwd", "auth_token", "secret_key", "access-key")


def _parts(template: str, salt: int) -> Column:
    """The template as an array of (kind, n, text, salt)."""
    cut = re.split(r"\{([hHbdwn])(\d*)\}", template)
    made = [("t", 0, cut[0], 0)]
    for k in range(1, len(cut), 3):
        made += [(cut[k], int(cut[k + 1] or 0), "", salt + k), ("t", 0, cut[k + 2], 0)]
    return F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("n"), F.lit(text).alias("text"), F.lit(s).alias("salt")) for kind, n, text, s in made])


def _fill(parts: Column, i: Column) -> Column:
    """A template's parts, filled from hashes of i."""

    def one(p):
        digest = F.sha2(F.concat_ws("-", i, p["salt"]), 512)
        pick = lambda words: F.element_at(F.array(*[F.lit(w) for w in words]), F.pmod(F.xxhash64(i, p["salt"]), F.lit(len(words))).cast("int") + 1)
        mixed = F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", "Q")
        return (
            F.when(p["kind"] == "t", p["text"]).when(p["kind"] == "h", digest.substr(F.lit(1), p["n"])).when(p["kind"] == "H", F.upper(digest.substr(F.lit(1), p["n"])))
            .when(p["kind"] == "b", mixed.substr(F.lit(1), p["n"])).when(p["kind"] == "d", F.translate(digest, "abcdef", "172839").substr(F.lit(1), p["n"]))
            .when(p["kind"] == "w", pick(_PLAIN)).otherwise(pick(_NAMED))
        )

    return F.concat_ws("", F.transform(parts, one))


def labelled_findings(spark: SparkSession, rows: int = FINDINGS) -> DataFrame:
    """(secret, found, before, after, label): the same findings for the same number of rows."""
    forms = F.array(*[
        F.struct(F.lit(float(label)).alias("label"), *[_parts(x, 100 * k + 20 * j).alias(name) for j, (name, x) in enumerate(zip(("before", "named", "raw", "after"), texts))])
        for k, (label, *texts) in enumerate(_FORMS)
    ])
    table = spark.range(1).select(F.posexplode(forms).alias("form", "f"))
    made = spark.range(rows).join(F.broadcast(table), F.pmod("id", F.lit(len(_FORMS))) == F.col("form"))  # as many rows as there are forms
    lead = _parts("{w} {w} ", 9000)
    made = made.select(F.col("f.label").alias("label"), F.concat(_fill(lead, F.col("id")), _fill(F.col("f.before"), F.col("id"))).alias("before"), *[_fill(F.col(f"f.{c}"), F.col("id")).alias(c) for c in ("named", "raw", "after")])
    shout = F.pmod(F.xxhash64("before", "raw"), F.lit(6)) == 0
    up = lambda c: F.when(shout, F.upper(c)).otherwise(F.col(c))
    made = made.select("label", up("before").alias("before"), up("named").alias("named"), up("raw").alias("secret"), "after")
    return made.select("label", "secret", F.concat("named", "secret").alias("found"), "before", F.concat("after", F.lit("and on")).alias("after"))


_MODELS: dict[tuple, object] = {}


def train(spark: SparkSession, rows: int = FINDINGS, trees: int = TREES, depth: int = DEPTH):
    """The forest. Its findings are always the same, so an application trains it once."""
    key = (spark.sparkContext.applicationId, rows, trees, depth)
    if key not in _MODELS:
        found = features(labelled_findings(spark, rows))
        assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(found).select("x", "label").coalesce(2)
        _MODELS[key] = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=SEED, probabilityCol="p", rawPredictionCol="raw", predictionCol="y").fit(assembled)
    return _MODELS[key]


#: Noncharacters that mark where candidates begin and end; a text that holds one of a pair gets the other pair.
_MARKS = (("﷐", "﷑"), ("﷒", "﷓"))


def _cut(text: Column) -> Column:
    """The text cut at its candidates: what is before the first, then (found, rest) per candidate; null for null."""
    first = ~text.rlike("[" + "".join(_MARKS[0]) + "]")

    def cut(t, a, b):
        pieces = F.split(F.regexp_replace(t, f"({PATTERN})", f"{a}$1{b}"), a)
        return F.transform(pieces, lambda x, k: F.struct(F.when(k > 0, F.substring_index(x, b, 1)).otherwise(F.lit("")).alias("found"), F.when(k > 0, F.substr(x, F.instr(x, F.lit(b)) + 1)).otherwise(x).alias("rest")))

    (a, b), (c, d) = _MARKS
    return F.when(first, cut(text, a, b)).otherwise(cut(F.translate(text, c + d, "  "), c, d))


def _candidates(cut: DataFrame, *kept: str) -> DataFrame:
    """cut (_row, _cut, kept) with a row per candidate: kept, place k, start, secret, found, rest, before, after."""
    each = cut.select("_row", *kept, "_cut", F.posexplode("_cut").alias("k", "c"))
    n = F.length("c.found") + F.length("c.rest")
    at = lambda step: F.coalesce(F.get(F.col("_cut"), F.col("k") + step), F.struct(F.lit("").alias("found"), F.lit("").alias("rest")))
    lead = F.concat(at(-2)["found"], at(-2)["rest"], at(-1)["found"], at(-1)["rest"])
    tail = F.concat(F.col("c.rest"), at(1)["found"], at(1)["rest"])
    placed = each.select("_row", *kept, "k", F.col("c.found").alias("found"), F.col("c.rest").alias("rest"), F.right(lead, F.lit(CONTEXT)).alias("before"), F.left(tail, F.lit(CONTEXT)).alias("after"), n.alias("n"))
    secret = F.regexp_replace("found", _VALUE, "")
    placed = placed.withColumn("at", F.coalesce(F.sum("n").over(Window.partitionBy("_row").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.withColumn("secret", secret).withColumn("start", F.col("at") + F.length("found") - F.length("secret")).drop("n", "at")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, secret, start, found, before, after) of every place of a candidate, start from 0.

    before and after hold up to CONTEXT characters, as far as the neighbouring candidates' surroundings reach.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("_row"), _cut(F.col(text_col)).alias("_cut")).where(F.size("_cut") > 1)
    return _candidates(rows, "doc_id").where((F.col("k") > 0) & (F.length("secret") >= 6)).select("doc_id", "secret", "start", "found", "before", "after", "_row", "k")


def _scored(found: DataFrame, keep: float, model) -> DataFrame:
    """found with score and is_secret, which all places of one string in a row share."""
    scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(features(found)))
    scored = scored.withColumn("score", vector_to_array("p")[1])
    return scored.withColumn("is_secret", F.max(F.col("score") >= keep).over(Window.partitionBy("_row", "secret")))


def scan(docs: DataFrame, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text", model=None) -> DataFrame:
    """(doc_id, start, length, secret, score, is_secret) of every place of a candidate in each row of docs.

    score is the forest's share for a real secret at this place; a string that is a secret at one place of a row is one
    at its others too. Null, empty and clean texts give no rows; repeated rows and null ids are scanned like any other;
    an empty table gives no rows; other columns are ignored. Candidates run to their natural end, however long.
    """
    scored = _scored(candidates(docs, id_col, text_col), keep, model or train(docs.sparkSession))
    return scored.select("doc_id", "start", F.length("secret").alias("length"), "secret", "score", "is_secret")


def redact(docs: DataFrame, keep: float = KEEP, mask: str = MASK, text_col: str = "text", model=None) -> DataFrame:
    """docs, same rows and columns, with each secret in the text replaced by mask.

    Rows are masked by themselves, so null and repeated ids and repeated rows are no matter; null and empty texts stay,
    an empty table gives no rows, other columns may have any names. Only rows with candidates are shuffled.
    """
    model = model or train(docs.sparkSession)
    names = [f"_c{k}" for k in range(len(docs.columns))]  # the columns of docs may have any names
    text = names[docs.columns.index(text_col)]
    cut = docs.toDF(*names).withColumn("_cut", _cut(F.col(text)))
    table = materialize(cut.select(*[F.when((F.size("_cut") <= 1) | F.col("_cut").isNull(), F.col(c)).alias(c) if c == text else F.col(c) for c in names], F.when(F.size("_cut") > 1, F.col("_cut")).alias("_cut"), F.monotonically_increasing_id().alias("_row")), "cut")
    clean, held = table.where("_cut is null"), table.where("_cut is not null")
    each = _candidates(held)
    scored = _scored(each.where((F.col("k") > 0) & (F.length("secret") >= 6)), keep, model).where("is_secret").select("_row", "k", F.lit(True).alias("hit"))
    parts = each.select("_row", "k", "found", "secret", "rest").join(scored, ["_row", "k"], "left")
    named = F.expr("left(found, length(found) - length(secret))")
    shown = F.concat(F.when(F.col("hit"), F.concat(named, F.lit(mask))).otherwise(F.col("found")), F.col("rest"))
    texts = parts.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("k", shown.alias("s")))).alias("all")).select("_row", F.concat_ws("", F.transform("all", lambda x: x["s"])).alias("_masked"))
    masked = held.drop("_cut").join(texts, "_row").select(*[F.col("_masked").alias(c) if c == text else F.col(c) for c in names])
    return clean.select(*names).union(masked).toDF(*docs.columns)
