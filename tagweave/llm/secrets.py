"""Secret scans by a random forest over candidate strings, in DataFrame and SQL functions only.

A candidate is a private key block, a value assigned to a word for secrets, of any length and with any
punctuation, or a run of at least twelve key characters that has a digit, a known start or a capital
behind a small letter. What is no secret among them is for the forest to say. Its features are its length, its changes of character class, the share of it that plain words cover, the
path of its text, and the words beside it. A forest trained on labelled findings says which candidates
are secrets. Its trees become one SQL expression, so documents are scored where they are, without
exploding candidates and without a shuffle.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.session import stage

# What candidates and the words beside them look like.
SECRET_WORDS = (
    "token secret password passwd pwd apikey api_key api-key accesskey access_key secret_key auth authorization "
    "bearer credential credentials private_key client_secret signing_key webhook session_key"
).split()
OTHER_WORDS = (
    "commit sha sha1 sha256 sha512 md5 checksum digest etag uuid guid revision rev hash integrity blob tree card "
    "phone isbn order invoice id ref build version serial number tracking object trace request"
).split()
PLAIN_WORDS = (
    "access account address admin app array async base block body box build button cache call change "
    "check class client code color column config content control count create data date debug default "
    "demo doc element email error event example field file filter folder form format function group "
    "handler hash header height help home host html http image index info input insert item key label "
    "layer left length level line link list load local login main make map max menu message method model "
    "module name new next node number object open option order output page param parse path point port "
    "post print public query read remove render report request reset result right role row run sample "
    "save schema scroll search select server session set size sort source start state status string style "
    "submit sum table tag target task temp test text time title token tool top total track tree type "
    "update upload url use user util value version view wait web width window word write your"
).split()
KNOWN = r"(?:AKIA|ASIA|gh[opsu]_|glpat-|xox[abprs]-|sk[-_]|AIza|eyJ)"
KNOWN_STARTS = rf"^(?:{KNOWN}|-----BEGIN)"
_MARK = "[A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
BLOCK = rf"-----BEGIN {_MARK}[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END {_MARK}"
KEY = "[A-Za-z0-9_+/-]"
_DIGIT, _CAPITAL = "[A-Za-z_+/-]*+[0-9]", "[A-Z_+/-]*+[a-z][a-z_+/-]*+[A-Z]"
_RUN = rf"(?={KNOWN}|{_DIGIT}|{_CAPITAL}){KEY}{{12,}}+={{0,2}}"
# What a value stands behind. The long look back comes last, as the short ones fail at most places.
_SIGN = r"(?:=>|:=|[:=])[ \t]{0,3}"
_WORD = rf"(?i:{'|'.join(SECRET_WORDS)})\\?[\"'`]?[ \t]{{0,3}}{_SIGN}"
# A value ends where a run of its own begins: behind white space, or with a known start behind a mark.
_INNER = rf"(?!{KNOWN}{KEY}{{8}})(?!(?<=\s){_RUN})"


def _quoted(mark: str) -> str:
    inside = rf"(?:[A-Za-z0-9]++|\\[^\n]|[^A-Za-z0-9\\\n{mark}]{_INNER})++"
    escaped = rf"(?:[A-Za-z0-9]++|[^A-Za-z0-9\\\n{mark}]{_INNER})++"
    plain_at, escaped_at = rf"(?<=[^\\]{mark})(?<={_SIGN}{mark})", rf"(?<=\\{mark})(?<={_SIGN}\\{mark})"
    return (
        rf"{plain_at}(?<={_WORD}{mark}){inside}(?={mark})|"
        rf"{escaped_at}(?<={_WORD}\\{mark}){escaped}(?=\\{mark})"
    )


# Without quotes a value is one word; a mark belongs to it unless a space, the end or another name follows.
_BARE = (
    rf"(?<=[=:> \t])(?=[^\s\"'`=:>])(?<={_SIGN})(?<={_WORD})"
    rf"(?:[A-Za-z0-9]++|[^A-Za-z0-9\s\"'`\\&;,.()\[\]{{}}]{_INNER}|"
    rf"[\\&;,.()\[\]{{}}](?![&;,.()\[\]{{}}]{{0,8}}(?:[\s\"'`]|\z)|[\w.-]{{1,40}}[=:]){_INNER})++={{0,2}}"
)
CANDIDATE = "|".join([BLOCK, *map(_quoted, "\"'`"), _BARE, rf"(?<!{KEY}){_RUN}"])
OTHER_PATHS = r"(?i)(?:^|[/_.-])(?:tests?|specs?|examples?|fixtures?|mocks?|docs?|samples?|vendor|lock|sum)(?:[/_.-]|$)"
REDACTED = "[SECRET]"

#: Labelled findings that the forest is trained on where none are given, its trees and their depth.
FINDINGS, TREES, DEPTH = 4_000, 20, 6

#: Features of a candidate ``x.c`` with the texts ``x.l`` and ``x.r`` beside it, at path ``x.p``, in SQL.
FEATURES = {
    "log_length": "log2(length(x.c))",
    "class_changes": (
        "(length(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
        "x.c, '[a-z]+', 'a'), '[A-Z]+', 'A'), '[0-9]+', '0'), '[^a-zA-Z0-9]+', '-')) - 1) / length(x.c)"
    ),
    "digit_share": "length(regexp_replace(x.c, '[^0-9]+', '')) / length(x.c)",
    "upper_share": "length(regexp_replace(x.c, '[^A-Z]+', '')) / length(x.c)",
    "hexadecimal": "int(x.c rlike '^(?:[0-9a-f]+|[0-9A-F]+)$')",
    "only_digits": "int(x.c rlike '^[0-9_-]+$')",
    "separators": "length(regexp_replace(x.c, '[A-Za-z0-9]+', '')) / length(x.c)",
    "distinct": "size(array_distinct(split(x.c, ''))) / least(length(x.c), 64)",
    "plain_words": (
        "1 - length(regexp_replace(lower(x.c), "
        f"'{'|'.join(sorted(PLAIN_WORDS, key=len, reverse=True))}', '')) / length(x.c)"
    ),
    "known_start": f"int(x.c rlike '{KNOWN_STARTS}')",
    "secret_word": f"int(x.l rlike '(?i)(?:^|[^a-z])(?:[a-z]+[_-])?(?:{'|'.join(SECRET_WORDS)})[^A-Za-z0-9]{{0,8}}$')",
    "other_word": f"int(x.l rlike '(?i)(?:^|[^a-z])(?:{'|'.join(OTHER_WORDS)})[^A-Za-z0-9]{{0,8}}$')",
    "assigned": "int(x.l rlike '[=:] ?.?$')",
    "quoted": "int(left(x.r, 1) IN ('\"', '`'))",
    "other_path": f"int(x.p rlike '{OTHER_PATHS}')",
}


def candidates(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ``_found``, ``(c, l, r, f)`` of every candidate in order, and ``_between``.

    ``_between`` are the texts around candidates, one more than these; ``l`` and ``r`` are the ends of
    them that stand next to a candidate, ``f`` its features. ``path`` names the column with paths.
    """
    pattern = F.lit(CANDIDATE)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    p = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    cut = docs.withColumn("_c", F.regexp_extract_all(text, pattern, F.lit(0)))
    cut = cut.withColumn("_between", F.when(F.size("_c") > 0, F.split(text, CANDIDATE, -1)).otherwise(F.array(text)))
    cut = cut.withColumn("_p", p)
    beside = "transform(_c, (c, i) -> named_struct('c', c, 'l', right(_between[i], 48), 'r', left(_between[i + 1], 24), 'p', _p))"
    cut = cut.withColumn("_c", F.expr(beside))
    features = ", ".join(f"double({rule})" for rule in FEATURES.values())
    found = f"transform(_c, x -> named_struct('c', x.c, 'l', x.l, 'r', x.r, 'f', array({features})))"
    return cut.withColumn("_found", F.expr(found)).drop("_c", "_p")


def labelled_findings(spark: SparkSession, rows: int = FINDINGS) -> DataFrame:
    """``text, path, label``: findings by a stated rule, the same in every run.

    Keys, tokens, passwords and key blocks beside words for secrets are labelled 1. Digests, ids, numbers,
    paths and names beside words for those, secrets in tests that plain words make up, and what programs
    and sentences put behind a word for secrets, are labelled 0.
    """
    some = "element_at(array({}), int(1 + pmod(xxhash64(id, {}), {})))"

    def one_of(words: list[str], salt: int) -> str:
        return some.format(", ".join(f"'{w}'" for w in words), salt, len(words))

    # Each part is a column of its own: spelt out in every kind, they are too much code to compile.
    parts = {
        "hexes": "sha2(concat('a', id), 256)",
        "base": "regexp_replace(base64(unhex(sha2(concat('b', id), 256))), '[+/=]', 'x')",
        "digits": "right(concat('0000000000000000', cast(abs(xxhash64(id, 1)) as string)), 16)",
        "secret": one_of(SECRET_WORDS, 2),
        "other": one_of(OTHER_WORDS, 3),
        "joint": one_of([" = \"", ": ", "=", " = ", "=\"", ": \"", " "], 4),
        **{f"plain_{salt}": one_of(PLAIN_WORDS, salt) for salt in range(10, 14)},
        "before": one_of(["the", "use", "see", "with", "our", "export", "set", "# our"], 5),
        "after": one_of(["\"", "\";", "", " and", ".", "\"!!"], 6),
        "code": one_of(["src/main.py", "app/settings.env", "deploy/prod.yml", "lib/client.rb", ""], 7),
        "test": one_of(["tests/fixtures/a.json", "docs/example.md", "package-lock.json", "go.sum"], 8),
        "assign": one_of([" = ", ": ", "=", ":", " := "], 9),
        "quote": one_of(["\"", "\\'"], 15),
        "word": one_of(PLAIN_WORDS, 16),
        "second": one_of(PLAIN_WORDS, 17),
        "number": "pmod(abs(xxhash64(id, 18)), 1000)",
        "mark": one_of(list("!@$%*"), 19),
        "mark_2": one_of(list("#^&?~"), 20),
        "third": one_of(PLAIN_WORDS, 21),
        "fourth": one_of(PLAIN_WORDS, 22),
        "code_value": one_of(["None", "null", "true", "false", "str", "string", "${TOKEN}", "<your-token>", "os.environ", "get_token()", "user.password", "self.secret", "config.get(key)", "required", "***"], 23),
    }
    joined = {
        "names": "concat_ws('_', plain_10, plain_11, plain_12, plain_13, pmod(id, 97))",
        "letters": "translate(base, '0123456789', 'qRsTuVwXyZ')",
        "short": "concat(translate(left(hexes, int(4 + pmod(id, 5))), '0123456789', 'mnoprstuvw'), number)",
        "marked": "concat(left(base, int(2 + pmod(id, 5))), mark, substr(base, 9, 3), mark_2, substr(base, 13, 2))",
        "camel": "concat(word, initcap(second), initcap(third), initcap(fourth))",
        "hyphened": "concat(initcap(translate(left(hexes, 7), '0123456789', 'aeioulnrst')), '-', initcap(word), initcap(second))",
    }
    kinds = [
        # text, path, label
        ("concat(before, ' ', secret, joint, left(hexes, 40), after)", "code", 1),
        ("concat(before, ' ', upper(secret), joint, upper(left(hexes, 40)), after)", "code", 1),
        ("concat(before, ' ', secret, joint, left(base, int(20 + pmod(id, 20))), after)", "code", 1),
        ("concat(before, ' ', secret, joint, hexes, after)", "code", 1),
        ("concat(before, ' AKIA', upper(left(hexes, 16)), after)", "code", 1),
        ("concat(before, ' ghp_', left(base, 36), after)", "code", 1),
        ("concat('-----BEGIN RSA PRIVATE KEY-----\\n', base, '\\n-----END RSA PRIVATE KEY-----')", "code", 1),
        ("concat(before, ' AKIA', upper(translate(left(hexes, 16), '0123456789', 'QRSTUVWXYZ')), after)", "code", 1),
        ("concat(before, ' ', secret, joint, left(letters, int(20 + pmod(id, 20))), after)", "code", 1),
        ("concat(before, ' ', secret, assign, short)", "code", 1),
        ("concat(before, ' ', secret, assign, quote, short, quote)", "code", 1),
        ("concat(before, ' ', secret, assign, quote, marked, quote)", "code", 1),
        ("concat(before, ' ', secret, assign, marked)", "code", 1),
        ("concat('-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: 1\n\n', base, '\n-----END PGP PRIVATE KEY BLOCK-----')", "code", 1),
        ("concat('-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,', upper(left(hexes, 32)), '\n\n', base, '\n-----END RSA PRIVATE KEY-----')", "code", 1),
        ("concat(before, ' ', other, joint, left(hexes, 40), after)", "code", 0),
        ("concat(before, ' ', other, joint, hexes, after)", "test", 0),
        ("concat(before, ' ', other, joint, concat_ws('-', left(hexes, 8), substr(hexes, 9, 4), substr(hexes, 13, 4), substr(hexes, 17, 4), substr(hexes, 21, 12)))", "code", 0),
        ("concat(before, ' ', digits, ' ', after)", "code", 0),
        ("concat(before, ' ', other, joint, digits, after)", "code", 0),
        ("concat(before, ' ', names, after)", "code", 0),
        ("concat(before, ' ', replace(names, '_', '/'), after)", "code", 0),
        ("concat(before, ' ', secret, joint, names, after)", "test", 0),
        ("concat(before, ' ', left(hexes, 40), ' ', after)", "test", 0),
        ("concat(before, ' ', camel, ' ', after)", "code", 0),
        ("concat(before, ' ', hyphened, ' ', after)", "code", 0),
        ("concat(before, ' ', secret, assign, word, ' ', second)", "code", 0),
        ("concat(before, ' ', secret, assign, quote, word, ' ', second, ' ', names, quote)", "code", 0),
        ("concat(before, ' ', secret, assign, code_value)", "code", 0),
        ("concat(before, ' ', secret, assign, quote, word, quote)", "code", 0),
        ("concat(before, ' ', secret, assign, camel)", "code", 0),
    ]
    text = " ".join(f"WHEN {i} THEN {t}" for i, (t, _, _) in enumerate(kinds))
    path = " ".join(f"WHEN {i} THEN {p}" for i, (_, p, _) in enumerate(kinds))
    label = " ".join(f"WHEN {i} THEN {y}" for i, (_, _, y) in enumerate(kinds))
    which = f"pmod(id, {len(kinds)})"
    ids = spark.range(rows).selectExpr("id", *(f"{rule} AS {name}" for name, rule in parts.items()))
    return ids.selectExpr("*", *(f"{rule} AS {name}" for name, rule in joined.items())).selectExpr(
        f"CASE {which} {text} END AS text", f"CASE {which} {path} END AS path", f"CASE {which} {label} END AS label"
    )


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> str:
    """A forest as an SQL expression over an array ``f`` of features: the share of trees that say secret.

    ``findings`` are ``text, path, label``, a bounded table; every candidate of a text has its label.
    Their features are written once. Without findings, or with one label only, the share is that of the
    label, and 0 without any.
    """
    names = list(FEATURES)
    rows = candidates(findings, "path").select("label", F.explode("_found.f").alias("f"))
    rows = rows.where("label IS NOT NULL").select(
        F.col("label").cast("double").alias("label"), *(F.col("f")[i].alias(name) for i, name in enumerate(names))
    )
    # in one file, as the forest depends on the order of rows
    rows = stage(rows.coalesce(1), "findings")
    seen = sorted(r.label for r in rows.select("label").distinct().limit(3).collect())
    if len(seen) < 2:
        return f"{seen[0] if seen else 0.0}D"
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(rows.coalesce(1))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird")
    votes = [_expression(tree._call_java("rootNode")) for tree in forest.fit(ready).trees]
    return f"({' + '.join(votes)}) / {len(votes)}D"


def _expression(node) -> str:  # noqa: ANN001
    if node.subtreeDepth() == 0:
        return f"{node.prediction()}D"
    split = node.split()
    rule = f"f[{split.featureIndex()}] <= {split.threshold()!r}D"
    return f"IF({rule}, {_expression(node.leftChild())}, {_expression(node.rightChild())})"


def secrets(docs: DataFrame, forest: str, path: str | None = None, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``_between`` and ``_scored``, ``(c, score, secret)`` of every candidate in order."""
    scored = f"transform(_found, x -> named_struct('c', x.c, 'score', {forest.replace('f[', 'x.f[')}))"
    found = candidates(docs, path).withColumn("_scored", F.expr(scored)).drop("_found")
    marked = F.transform(
        "_scored", lambda x: F.struct(x["c"].alias("c"), x["score"].alias("score"), (x["score"] >= threshold).alias("secret"))
    )
    return found.withColumn("_scored", marked)


def _redacted():  # noqa: ANN202
    parts = F.transform(
        F.col("_between"),
        lambda between, i: F.when(i < F.size("_scored"), F.concat(between, F.when(F.get("_scored", i)["secret"], F.lit(REDACTED)).otherwise(F.get("_scored", i)["c"]))).otherwise(between),
    )
    return F.array_join(parts, "")


def scan(docs: DataFrame, forest: str, path: str | None = None) -> DataFrame:
    """``doc_id, n_candidates, n_secrets, findings, redacted`` of every row.

    ``findings`` are ``(start, end, score)`` of secrets in code points, ``redacted`` is the text with
    every secret replaced. Null and empty texts have no candidates and an empty ``redacted``. Null ids
    and repeated rows are kept; no rows give no rows; extra columns are not read but for the one that
    ``path`` names.
    """
    found = secrets(docs.select("doc_id", "text", *([path] if path else [])), forest, path)
    sized = found.withColumn("_sizes", F.zip_with("_between", "_scored", lambda b, s: F.length(b) + F.coalesce(F.length(s["c"]), F.lit(0))))
    placed = F.transform("_scored", lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    placed = F.filter(placed, lambda x: x["s"]["secret"])

    def place(x):  # noqa: ANN001, ANN202
        end = F.aggregate(F.slice("_sizes", F.lit(1), x["i"] + 1), F.lit(0), lambda total, n: total + n)
        return F.struct((end - F.length(x["s"]["c"])).alias("start"), end.alias("end"), x["s"]["score"].alias("score"))

    return sized.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("_scored").cast("long").alias("n_candidates"),
        F.size(F.filter("_scored", lambda s: s["secret"])).cast("long").alias("n_secrets"),
        F.transform(placed, place).alias("findings"),
        _redacted().alias("redacted"),
    )


def redact(docs: DataFrame, forest: str, path: str | None = None) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced and ``n_chars``, if there, set to the new length.

    Rows without a secret stay as they are, null texts included.
    """
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"), *([F.col(path).alias("_path")] if path else []))
    found = secrets(inner, forest, "_path" if path else None)
    found = found.withColumn("_new", F.when(F.exists("_scored", lambda s: s["secret"]), _redacted()))
    columns = {c: F.col(f"_row.`{c}`") for c in docs.columns}
    columns["text"] = F.coalesce("_new", "_row.text")
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(F.col("_new").isNotNull(), F.length("_new").cast(kind)).otherwise(columns["n_chars"])
    return found.select(*[column.alias(c) for c, column in columns.items()])
