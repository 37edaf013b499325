"""Secret scan: candidates judged by a random forest that takes out false positives."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bound, stored

#: Blocks of private keys, dotted tokens, and runs of 16 or more of these characters.
CANDIDATE = r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[^-]{16,}-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----|(?<![A-Za-z0-9_+/-])(?:eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+)?|[A-Za-z0-9_+/-]{16,}={0,2})"
#: Ends of a context word: no letter before (or a capital after a small one), none behind (or a capital after a small one), an s aside.
STARTS, ENDS = r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))", r"(?i:s)?(?![a-z])(?!(?<=[A-Z])[A-Z])"
#: Words that announce a secret (the longer ones also at the end of a name: dbpassword), and those that announce harmless values. Fixed values.
SECRET_WORDS = rf"(?:(?i:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|private[_-]?key|credential)|{STARTS}(?i:pwd|auth(?:orization|entication)?|bearer)){ENDS}"
PLAIN_WORDS = rf"{STARTS}(?i:sha1(?:sum)?|sha256(?:sum)?|md5(?:sum)?|commit|digest|checksum|hash(?:es)?|uuid|revision|version|phone|card|order|invoice|example|test|dummy){ENDS}"
PLAIN_PATHS = r"(?i)(?:test|example|sample|fixture|mock|lock|\.md$|\.svg$|\.min\.js$)"
#: Forms that rules label without a doubt: of issued keys, and of harmless values.
KNOWN_SECRET = r"^(?:-----BEGIN |AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{20,})"
KNOWN_PLAIN = r"^(?:[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|(?:[A-Za-z]+[-_/])+[A-Za-z]*\d{0,4}|[A-Za-z]{2,}\d{1,4}|(.)\1+)$"
CONTEXT = 40
#: A value that begins behind this is assigned to something; behind a secret's name it is a candidate without a digit too.
ASSIGNED = r"[=:]\s*[\"']?$"
#: What the forest sees, in this order.
FEATURES = ["chars", "digits", "uppers", "letter_to_digit", "digit_to_letter", "case_changes", "distinct", "longest_letters", "vowels", "hexadecimal", "covered", "assigned", "quoted", "secret_word", "plain_word", "path_depth", "plain_path"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(doc, at, value, before, after, path): all candidates of whole texts with CONTEXT characters on both sides.

    A candidate has a letter, and a digit unless it is assigned to a secret's name.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("doc"), path.alias("path"), text.alias("text")).filter(F.length("text") >= 16)

    def cut(found: Column) -> Column:
        def placed(plain: Column) -> Column:
            start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("array<struct<at:int,value:string,before:string,after:string>>").alias("out"))

            def step(s: Column, i: Column) -> Column:
                at = s["at"] + F.length(plain[i])
                one = F.struct(at.alias("at"), found[i].alias("value"), F.right(plain[i], F.lit(CONTEXT)).alias("before"), F.substring(plain[i + 1], 1, CONTEXT).alias("after"))
                fits = found[i].rlike("[A-Za-z]") & (found[i].rlike("[0-9]") | (one["before"].rlike(ASSIGNED) & one["before"].rlike(SECRET_WORDS)))
                own = F.coalesce(s["out"], F.array().cast("array<struct<at:int,value:string,before:string,after:string>>"))
                return F.struct((at + F.length(found[i])).alias("at"), F.when(fits, F.array_append(own, one)).otherwise(own).alias("out"))

            return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step)["out"]

        return F.when(F.exists(found, lambda v: v.rlike("[A-Za-z]")), bound(F.split("text", CANDIDATE, -1), placed))

    found = bound(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)), cut)
    return rows.select("doc", "path", F.explode(found).alias("x")).select("doc", "path", "x.*")


def dictionary(docs: DataFrame, words: DataFrame, text_col: str, least_docs: int) -> DataFrame:
    """Those of ``words`` (word) that least_docs texts or more hold as words of their own."""
    texts = docs.select(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"(?<![\p{L}\p{N}_])\p{L}{3,}(?![\p{L}\p{N}_])"), F.lit(0))).alias("own"))
    seen = texts.select(F.explode("own").alias("word"))
    return seen.join(words, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_docs).select("word")


def featured(found: DataFrame, docs: DataFrame, text_col: str, least_docs: int, broadcast_words: int) -> DataFrame:
    """Adds FEATURES to candidates. Coverage is the share of a candidate's letters in runs that are words of the texts."""
    value = F.col("value")
    count = lambda pattern: F.regexp_count(value, F.lit(pattern)).cast("double")
    runs = F.regexp_extract_all(F.lower(value), F.lit(r"[a-z]{3,}"), F.lit(0))
    out = found.withColumn("runs", runs)
    words = stored(out.select(F.explode("runs").alias("word")).distinct(), "words")
    known = dictionary(docs, F.broadcast(words) if words.count() <= broadcast_words else words, text_col, least_docs)
    pieces = out.select("value", F.explode(F.array_distinct("runs")).alias("word")).distinct()
    covered = pieces.join(known, "word").groupBy("value").agg(F.collect_set("word").alias("words"))
    out = out.join(covered, "value", "left")
    letters = lambda runs: F.aggregate(runs, F.lit(0), lambda s, w: s + F.length(w)).cast("double")
    own = F.filter("runs", lambda w: F.array_contains(F.coalesce("words", F.array().cast("array<string>")), w))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    size = F.length(value).cast("double")
    return out.withColumns(
        {
            "chars": size,
            "digits": count("[0-9]") / size,
            "uppers": count("[A-Z]") / size,
            "letter_to_digit": count("[A-Za-z](?=[0-9])") / size,
            "digit_to_letter": count("[0-9](?=[A-Za-z])") / size,
            "case_changes": count("[a-z](?=[A-Z])") / size,
            "distinct": F.size(F.array_distinct(F.split(value, ""))) / size,
            "longest_letters": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(value, F.lit("[A-Za-z]+"), F.lit(0)), F.length)), F.lit(0)) / size,
            "vowels": count("(?i)[aeiou]") / size,
            "hexadecimal": flag(value.rlike("^[0-9a-fA-F]+$")),
            "covered": letters(own) / size,
            "assigned": flag(F.col("before").rlike(ASSIGNED)),
            "quoted": flag(F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")),
            "secret_word": flag(F.col("before").rlike(SECRET_WORDS)),
            "plain_word": flag(F.col("before").rlike(PLAIN_WORDS)),
            "path_depth": F.size(F.split("path", "/")).cast("double"),
            "plain_path": flag(F.col("path").rlike(PLAIN_PATHS)),
        }
    ).drop("runs", "words")


def settled() -> Column:
    """The label that rules give a candidate, 1.0 or 0.0, else null: forms of issued keys, values assigned to a secret's name; known harmless forms, words in prose.

    A value assigned to a secret's name is never 0.0: with a plain word before it, a harmless form or words inside it stays unlabelled.
    """
    named, harmless = (F.col("secret_word") == 1) & (F.col("assigned") == 1), F.col("value").rlike(KNOWN_PLAIN)
    secret = (F.col("value").rlike(KNOWN_SECRET) | (named & (F.col("plain_word") == 0) & (F.col("covered") < 0.5))) & ~harmless
    plain = ~named & (harmless | (F.col("plain_word") == 1) | ((F.col("assigned") == 0) & (F.col("secret_word") == 0) & (F.col("hexadecimal") == 0)) | (F.col("covered") >= 0.5))
    return F.when(secret, 1.0).when(plain, 0.0)


def labelled(found: DataFrame) -> DataFrame:
    """Candidates that rules settle, with their label."""
    return found.withColumn("label", settled()).filter("label IS NOT NULL")


#: Words that made-up names consist of, and words of made-up sentences.
NAME_WORDS = "user account request handler config session buffer stream record index module widget parser order invoice client server cache queue value table result message service manager factory context element header button image page panel report export import update delete insert select filter group sort".split()
PROSE = "the report was sent before noon and nobody asked why it took so long because every page had been read twice by then so they went home early that day".split()


def made_findings(spark: SparkSession, n: int = 6000, seed: str = "findings") -> DataFrame:
    """(doc_id, text, source, label): n labelled findings made from hashes of their number, half of them secrets, for corpora without findings of their own.

    Secrets: keys in the forms of known issuers, and random hexadecimal, base64 and mixed values behind names of secrets. False positives: digests and commits, UUIDs,
    names, paths, versions and file names in prose or assigned, base64 of prose, repeated characters, and names behind a secret's name. The table depends on n and seed only.
    """
    rows = spark.range(n)
    said = lambda salt: F.sha2(F.concat_ws("|", F.lit(seed), F.col("id"), F.lit(salt)), 256)
    number = lambda salt, most: (F.conv(F.substring(said(salt), 1, 12), 16, 10).cast("long") % most).cast("int")
    pick = lambda salt, words: F.get(F.array(*map(F.lit, words)), number(salt, len(words)))
    mixed = lambda salt: F.translate(F.concat(F.base64(F.unhex(said(salt))), F.base64(F.unhex(said(salt + "'")))), "+/=", "x7Q")
    size = 20 + number("size", 25)
    names = [pick(f"name{i}", NAME_WORDS) for i in range(4)]
    camel = F.concat(names[0], *[F.initcap(x) for x in names[1:3]], number("digit", 100).cast("string"))
    uuid = F.regexp_replace(F.substring(said("uuid"), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    prose = lambda salt, k: F.concat_ws(" ", *[pick(f"{salt}{i}", PROSE) for i in range(k)])
    secret = [F.concat(F.lit("AKIA"), F.substring(F.upper(mixed("aws")), 1, 16)), F.concat(F.lit("ghp_"), F.substring(mixed("hub"), 1, 36)), F.concat(F.lit("sk_live_"), F.substring(mixed("pay"), 1, 24)), F.concat(F.lit("xoxb-"), number("chat", 10**9).cast("string"), F.lit("-"), F.substring(mixed("chat"), 1, 24)), F.concat(F.lit("eyJ"), F.substring(mixed("jwt"), 1, 24), F.lit("."), F.substring(mixed("jwu"), 1, 30)), F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----"), mixed("pem"), mixed("per"), F.lit("-----END RSA PRIVATE KEY-----")), F.substring(said("hex"), F.lit(1), F.lit(32) + 8 * number("hexsize", 5)), F.substring(mixed("key"), F.lit(1), size), F.concat(F.base64(F.unhex(F.substring(said("b64"), 1, 48)))), F.substring(said("hex2"), F.lit(1), F.lit(40))]
    plain = [said("digest"), F.substring(said("commit"), 1, 40), uuid, camel, F.concat_ws("_", *names, number("digit", 1000).cast("string")), F.concat(F.concat_ws("/", *names), number("digit", 10).cast("string")), F.concat(F.concat_ws("-", *names[:3]), F.lit("-v"), number("digit", 30).cast("string")), F.base64(F.concat_ws(" ", *names).cast("binary")), F.repeat(F.concat(F.substring(said("one"), 1, 1), F.lit("a1")), 8), F.concat_ws("-", *names)]
    label = F.pmod(F.col("id"), F.lit(2)).cast("double")
    kind = F.floor(F.col("id") / 2)
    value = F.when(label == 1, F.get(F.array(*secret), (kind % len(secret)).cast("int"))).otherwise(F.get(F.array(*plain), (kind % len(plain)).cast("int")))
    named = F.concat(pick("kind", ["token", "api_key", "password", "secret", "access_key", "client_secret", "db_password", "AUTH_TOKEN"]), pick("assign", [' = "', ": ", "=", ': "']))
    marked = F.concat(pick("mark", ["commit ", "sha256:", "md5 ", "checksum ", "version ", "uuid ", "digest: ", "see ", "file ", "id: ", "name = \"", "path=", "at ", ""]))
    # Issued forms also stand alone; a name behind a secret's name is a false positive too.
    issued, lone = (label == 1) & (kind % len(secret) < 6), number("lone", 4) == 0
    before = F.when(issued & lone, F.lit("")).when(label == 1, named).when((kind % len(plain)).isin(3, 4, 9) & (number("trap", 3) == 0), named).otherwise(marked)
    quote = F.when(F.endswith(before, F.lit('"')), F.lit('"')).otherwise(F.lit(""))
    text = F.concat(prose("p", 8), F.lit(" "), before, value, quote, F.lit(" "), prose("s", 8))
    source = pick("source", ["src0", "src7", "src12", "src19", "app/settings.py", "docs/readme.md", "tests/data/sample.json", "lib/package.lock"])
    return rows.select(F.col("id").alias("doc_id"), text.alias("text"), source.alias("source"), label.alias("label"))


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", max_findings: int = 20_000, trees: int = 20, depth: int = 6, least_docs: int = 5, least_score: float = 0.5, broadcast_words: int = 500_000, seed: int = 11) -> DataFrame:
    """Judges every candidate of every whole text: id_col, at (first character, from 0), length, masked, score, is_secret.

    Candidates are runs of 16 or more of [A-Za-z0-9_+/-] with a letter and (unless assigned to a secret's name) a digit, dotted
    tokens, and blocks of private keys. A random forest sees their length,
    transitions between kinds of characters, coverage by words of the texts, path and neighbouring words, and
    gives a score; from least_score on the candidate is a secret, else a false positive.
    It is fitted on labelled findings (id_col, at, label 1 or 0); where none are given, on made_findings and on those candidates that rules settle without a
    doubt; at most half of max_findings of either label, taken by hash, both weighing the same together. masked shows the first four characters only.

    A word counts for coverage if least_docs texts hold it. Where findings are given, but of one label only, there is no forest: a finding's
    score is its label, that of other candidates the label rules give them, and 0.5 where they give none.
    Null or empty texts have no candidates; repeated rows give repeated results; a null id comes back as null. Extra columns are left
    out, so none clashes; an empty table gives an empty one.
    """
    found = stored(featured(candidates(docs, id_col, text_col, path_col), docs, text_col, least_docs, broadcast_words), "found")
    sure = labelled(found)
    if findings is not None:
        sure = found.join(findings.select(F.col(id_col).alias("doc"), "at", F.col("label").cast("double").alias("label")), ["doc", "at"])
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    own = [vectors.transform(sure.filter(F.col("label") == label).orderBy(F.xxhash64("doc", "at", "value"), "doc", "at").limit(max_findings // 2)).select("features", "label") for label in (0.0, 1.0)]
    sample = own[0].union(own[1])
    if findings is None:
        made = stored(made_findings(docs.sparkSession), "made")
        known = featured(candidates(made), docs, text_col, least_docs, broadcast_words).join(made.select(F.col("doc_id").alias("doc"), "label"), "doc")
        sample = sample.union(vectors.transform(known).select("features", "label"))
    sample = stored(sample, "findings")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(sizes) == 2:
        sample = sample.withColumn("weight", F.when(F.col("label") == 1, 1.0 / sizes[1.0]).otherwise(1.0 / sizes[0.0]) * (sum(sizes.values()) / 2))
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", weightCol="weight").fit(sample)
        judged = forest.transform(vectors.transform(found)).withColumn("score", vector_to_array("probability")[1])
    else:
        judged = found.withColumn("score", F.coalesce(settled(), F.lit(0.5)))
        if findings is not None:
            given = sure.groupBy("doc", "at").agg(F.max("label").alias("given"))
            judged = judged.join(given, ["doc", "at"], "left").withColumn("score", F.coalesce("given", "score"))
    masked = F.concat(F.substring("value", 1, 4), F.repeat(F.lit("*"), F.length("value") - 4))
    return judged.select(F.col("doc").alias(id_col), F.col("at").cast("long").alias("at"), F.length("value").cast("long").alias("length"), masked.alias("masked"), F.round("score", 6).alias("score"), (F.col("score") >= least_score).alias("is_secret"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
