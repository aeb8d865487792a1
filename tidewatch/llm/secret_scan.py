"""Secret scans: every string that might be one, judged by a random forest to remove false findings.

Candidates are private key blocks, logins within addresses, values of any signs that an assignment to a
telling name announces, and long runs of the characters that keys are made of, with dots between them too. The
forest sees their length, how they
pass from one kind of character to the next and how usual their pairs of letters are, how much of them
dictionary words cover, whether they have a provider's form or are part of a path, and which words stand around them. It is trained
from labelled findings and then written out as an expression, so that documents are scanned, judged and
redacted row by row, without Python and without moving a text.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stored
from tidewatch.llm.words import let, settled, text_of

#: How names end that announce a secret, and an assignment to one.
NAMES = "pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth"
ASSIGNED = """[:=][ \\t]{0,2}["'`]?"""
_PEM = r"[A-Z ]{0,32}PRIVATE KEY(?: BLOCK)?-----"
#: What may be a secret. Every part is bounded or possessive, so a text is read in time that grows with its length.
CANDIDATE = "|".join(
    [
        rf"-----BEGIN {_PEM}[^-]{{1,16384}}+-----END {_PEM}",
        r"""(?<=://)[^\s:/@"'<>]{1,64}+:[^\s/@"'<>]{1,128}+(?=@)""",
        rf"""(?<={ASSIGNED})(?<=(?i:{NAMES})["']?[ \t]{{0,2}}{ASSIGNED})[^\s"'`,;<>()]{{6,512}}+""",
        r"SG\.[A-Za-z0-9_-]{16,}+\.[A-Za-z0-9_-]{16,}+",
        r"[A-Za-z0-9_-]{16,}+(?:\.[A-Za-z0-9_-]{16,}+)++",
        "[A-Za-z0-9+/_-]{16,}+={0,2}",
    ]
)
#: How keys of known providers begin, a private key block, and a login within an address.
KNOWN = (
    r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk_live_|rk_live_|sk-[A-Za-z0-9]|xox[abprs]-|AIza|SG\.|eyJ[A-Za-z0-9_-]+\.|npm_|ya29\.|-----BEGIN)"
)
#: Characters before and after a candidate that count as its neighbours.
BEFORE, AFTER = 48, 24
REDACTED = "[SECRET]"
TREES, DEPTH = 16, 6
#: Labelled findings that a forest is trained on at most, and documents that lend them words.
TRAINING_ROWS = 6_000
WORD_DOCUMENTS = 200
WORDS_EACH = 50

KEY_WORDS = "token|secret|passw|pwd|api.?key|access.?key|private.?key|auth|bearer|credential|signature"
DECOY_WORDS = (
    "example|sample|dummy|test|fake|placeholder|redacted|your|sha1|sha256|sha-|md5|digest|checksum|commit|revision"
    "|uuid|guid|etag|hash|order|invoice|card|phone|serial|isbn"
)
DICTIONARY = (
    "about access account action address admin after again agent alias array auth base before build bytes cache call"
    " change class client close code color column common config connect content context control copy count create"
    " current data date debug default delete detail device digest double driver element email enable error event example"
    " export false field file filter final first float format frame function global group handle header height hello"
    " image import index info input insert instance integer internal item join key label language layer left length level"
    " library line link list local lock main manager message method mode model module name network next node null number"
    " object option order output package page param parent password path place point port prefix print private process"
    " project public query read record remove report request reset result return right root row save schema search secret"
    " select server service session set size source spark start state static status stop store string style system table"
    " target task template test text thread time title token total true type unit update user utils value version view"
    " width window word world write"
).split()
#: Pairs of letters that running text is full of.
PAIRS = (
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic"
    " ne ea ra ce li ch ll be ma si om ur"
).split()

FEATURES = (
    "length transitions usual_pairs dictionary digits upper distinct in_path key_word decoy_word assigned known signs"
).split()


def _share(count: Column, of: Column) -> Column:
    return count / F.greatest(of, F.lit(1))


def features(candidate: Column, before: Column, after: Column) -> Column:
    """FEATURES of a candidate, an array of doubles."""
    small, size = F.lower(candidate), F.length(candidate)
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kinds = F.translate(candidate, lower + upper + digit, "a" * 26 + "A" * 26 + "0" * 10)
    changes = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1
    # each place is looked at once
    pairs = F.regexp_count(small, F.lit(f"(?={'|'.join(PAIRS)})"))
    uncovered = F.length(F.regexp_replace(small, "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    near_before, near_after = F.lower(before), F.lower(after)
    neighbours = F.concat_ws(" ", near_before, near_after)
    in_path = before.rlike(r"[/\\.~]$") | after.rlike(r"^(/|\\|\.[a-z])") | candidate.rlike("[a-z]/[a-z]")
    return F.array(
        size.cast("double"),
        _share(changes, size),
        _share(pairs, size - 1),
        _share(size - uncovered, size),
        _share(size - F.length(F.translate(candidate, digit, "")), size),
        _share(size - F.length(F.translate(candidate, upper, "")), size),
        _share(F.size(F.array_distinct(F.split(candidate, ""))), size),
        in_path.cast("double"),
        near_before.rlike(KEY_WORDS).cast("double"),
        (neighbours.rlike(DECOY_WORDS) | small.rlike(DECOY_WORDS)).cast("double"),
        before.rlike("[=:]\\s*[\"'`]?$").cast("double"),
        (candidate.rlike(KNOWN) | before.endswith("://") & candidate.contains(":")).cast("double"),
        _share(size - F.length(F.regexp_replace(candidate, "[^A-Za-z0-9_-]", "")), size),
    )


def labelled_findings(docs: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """Labelled findings (candidate, before, after, label) made for training, at most `rows`.

    Secrets are digests, written in several alphabets, behind the words that announce secrets; keys in providers'
    forms, announced or not; passwords behind their names, and logins within addresses. False
    findings are what such scans stumble over: digests that are announced as such, numbers, identifiers and
    paths made of the words of up to WORD_DOCUMENTS documents (those with the least hashes), placeholders,
    variables and single words behind such names, and long words in running text. All of it follows from the row number and those words. A table without
    documents lends no words; the dictionary takes their place.
    """
    spark = docs.sparkSession
    lenders = docs.select(text_of().alias("t")).orderBy(F.xxhash64("t"), "t").limit(WORD_DOCUMENTS)
    lent = lenders.select(F.explode(F.expr(f"slice(regexp_extract_all(t, '[A-Za-z]{{3,}}', 0), 1, {WORDS_EACH})")).alias("w"))
    # at most WORDS_EACH words of each of those documents, looked up once when the rows are made
    given = F.split(F.lit(" ".join(DICTIONARY)), " ")
    words = lent.agg(F.concat(F.array_sort(F.collect_set("w")), given)).scalar()
    numbered = spark.range(rows).withColumn("digest", F.sha2(F.col("id").cast("string"), 256))

    def pick(values: list[str] | Column, salt: int) -> Column:
        listed = values if isinstance(values, Column) else F.array(*map(F.lit, values))
        return F.get(listed, F.pmod(F.xxhash64("id", F.lit(salt)), F.size(listed)).cast("int"))

    word = lambda salt: pick(words, salt)
    coded = F.translate(F.base64(F.unhex("digest")), "=", "")
    letters = lambda signs, n: F.substring(F.translate(coded, "+/", signs), 1, n)
    known = [
        F.concat(F.lit("AKIA"), F.upper(letters("XY", 16))),
        F.concat(F.lit("ghp_"), letters("ab", 36)),
        F.concat(F.lit("sk_live_"), letters("cd", 24)),
        F.concat(F.lit("AIza"), letters("_-", 35)),
        F.concat(F.lit("xoxb-"), F.substring(F.translate("digest", "abcdef", "123456"), 1, 12), F.lit("-"), letters("ef", 24)),
        F.concat(F.lit("eyJhbGciOiJIUzI1NiJ9.eyJ"), letters("_-", 40), F.lit("."), F.reverse(letters("_-", 43))),
        F.concat(F.lit("SG."), letters("_-", 22), F.lit("."), F.reverse(letters("_-", 43))),
        F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), F.repeat(F.concat(coded, F.lit("\n")), 6), F.lit("-----END RSA PRIVATE KEY-----")),
    ]
    random = [F.substring("digest", 1, 40), F.substring("digest", 1, 32), F.col("digest"), coded, letters("/+", 40)]
    size = F.pmod(F.xxhash64("id", F.lit(29)), F.lit(9)) + 8
    signs = F.translate(F.substring("digest", 20, 12), "01234abc", "!@$%^&*.")
    passwords = [
        F.substring(F.concat(F.substring(coded, 1, 5), signs), F.lit(1), size.cast("int")),
        F.concat(F.lower(word(3)), F.substring("digest", 2, 2), pick(["!", "", "#", "?x"], 28)),
        F.concat(F.initcap(word(3)), pick(["1!", "2024", "99$", "@7"], 28), F.initcap(word(4))),
    ]
    login = F.concat(F.lower(word(3)), F.lit(":"), F.substring(F.concat(F.substring(coded, 3, 6), signs), F.lit(1), size.cast("int")))
    announced = ['token = "', "secret: ", "password='", 'api_key = "', "API-KEY=", "Authorization: Bearer ", "access_key: ",
                 "client_secret=", 'auth_token: "', 'private_key = "', 'token="', "credentials: "]
    entry = ['password = "', "PASSWORD=", "pwd: ", "db_password='", "passwd=", 'secret = "', "password: "]
    schemes = ["postgres://", "mysql://", "amqp://", "https://", "redis://", "mongodb://"]
    plain, told = F.lit(""), pick(announced, 31)
    secrets = [(x, told) for x in random + known[:3]] + [(x, plain) for x in known] + [(x, pick(entry, 32)) for x in passwords]
    secrets.append((login, pick(schemes, 33)))
    sep = pick(["_", "-", "", "/"], 11)
    identifier = F.concat_ws("", word(1), sep, word(2), sep, word(3), sep, word(4), F.lit("_value"))
    falls = [
        (F.col("digest"), pick(["sha256: ", "sha256=", "digest = ", "checksum: "], 12)),
        (F.substring("digest", 1, 40), pick(["commit ", "revision: ", "commit = ", "sha1: "], 13)),
        (F.substring("digest", 1, 32), pick(["md5: ", "etag = ", "uuid: ", "hash = "], 14)),
        (F.substring(F.translate("digest", "abcdef", "123456"), 1, 16), F.concat(word(5), F.lit(" "))),
        (F.substring(F.translate("digest", "abcdef", "987654"), 1, 16), pick(["order ", "card ", "phone: ", "call "], 15)),
        (identifier, F.concat(word(6), F.lit(" "))),
        (identifier, pick(announced, 16)),
        (F.concat_ws("/", F.lit("usr"), word(1), word(2), word(3)), pick(["see /", "file: /", "../", "token file /"], 17)),
        (F.concat(pick(["your_", "example_", "placeholder_", "dummy_"], 18), word(1), F.lit("_goes_here")), pick(announced, 19)),
        (F.repeat(pick(["x", "0", "-", "_"], 20), 24), pick(announced, 21)),
        (F.repeat(coded, 12), pick(["", "data:image/png;base64,", 'src="', "content: "], 34)),
        (F.concat(word(1), F.lit("_"), word(2)), pick(entry, 23)),
        (F.concat(F.lower(word(1)), pick(["", ".", ":", "!"], 25)), pick(["password: ", "secret: ", "token: ", "auth = "], 24)),
        (F.concat(pick(["${", "$", "{{", "%"], 26), F.upper(word(1)), pick(["}", "_VAR", "}}", "%"], 26)), pick(entry, 27)),
        (F.concat_ws(".", F.concat(word(1), F.lit("_"), word(2), word(3)), F.concat(word(4), F.lit("_"), word(5), word(6))), F.concat(word(7), F.lit(" "))),
        (F.concat(F.lower(word(1)), F.lower(word(2)), F.lower(word(3)), F.lower(word(4)), F.lit("ation")), F.concat(word(7), F.lit(" "))),
    ]
    closing = pick(['"', "'", " ", "", "\n"], 22)
    lead = F.concat(word(8), F.lit(" "), word(9), F.lit(" "))
    tail = F.concat(closing, F.lit(" "), word(10))

    def chosen(options: list, part) -> Column:
        at = F.pmod(F.xxhash64("id", F.lit(30)), F.lit(len(options)))
        return reduce(lambda other, k: F.when(at == k, part(options[k])).otherwise(other), range(len(options)), F.lit(None))

    label = (F.col("id") % 2).cast("double")
    made = numbered.select(
        F.when(label == 1, chosen(secrets, lambda s: s[0])).otherwise(chosen(falls, lambda f: f[0])).alias("candidate"),
        F.concat(lead, F.when(label == 1, chosen(secrets, lambda s: s[1])).otherwise(chosen(falls, lambda f: f[1]))).alias("before"),
        tail.alias("after"),
        label.alias("label"),
    )
    return made.where(F.length("candidate") >= 6)


def trained(labelled: DataFrame, seed: int = 17) -> RandomForestClassificationModel:
    """A forest for labelled findings (candidate, before, after, label)."""
    vectors = labelled.select(
        array_to_vector(features(F.col("candidate"), F.col("before"), F.col("after"))).alias("features"), "label"
    )
    return RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=seed, featuresCol="features", labelCol="label"
    ).fit(vectors)


def votes(forest: RandomForestClassificationModel, values: str) -> str:
    """The share of trees that take a finding for a secret, as an expression over an array of its features."""
    return "(" + " + ".join(_tree(tree.toDebugString, values) for tree in forest.trees) + f") / {len(forest.trees)}D"


def _tree(described: str, values: str) -> str:
    """A tree's description as nested conditions."""
    lines = [line.strip() for line in described.splitlines()[1:] if line.strip()]
    place = 0

    def node() -> str:
        nonlocal place
        line = lines[place]
        place += 1
        if leaf := re.match(r"Predict: (\S+)", line):
            return str(int(float(leaf[1])))
        feature, threshold = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        yes = node()
        place += 1  # the line of the opposite condition
        return f"if(get({values}, {feature}) <= {threshold}D, {yes}, {node()})"

    return node()


def scanned(docs: DataFrame, forest: RandomForestClassificationModel, least: float = 0.5) -> DataFrame:
    """The documents as `row`, with `parts` of the text between candidates, and `found`, one for each candidate.

    A candidate has `text`, `score` (share of trees) and `secret`. A null or empty text has none. Every row
    is judged by itself, whole, and whatever columns it has are kept in `row`, where none can clash.
    """
    rows = docs.select(F.struct("*").alias("row")).withColumn("t", text_of("row.text"))
    rows = rows.select("row", "t", F.split("t", CANDIDATE).alias("parts"), F.regexp_extract_all("t", F.lit(CANDIDATE), F.lit(0)).alias("texts"))
    size = F.size("texts")
    rows = rows.withColumn(
        "found", F.arrays_zip(F.col("texts").alias("text"), F.slice("parts", F.lit(1), size).alias("before"), F.slice("parts", F.lit(2), size).alias("after"))
    )
    seen = F.transform(
        "found",
        lambda f: F.struct(
            f["text"].alias("text"),
            features(
                f["text"],
                F.when(F.length(f["before"]) > BEFORE, F.substring(f["before"], -BEFORE, BEFORE)).otherwise(f["before"]),
                F.substring(f["after"], 1, AFTER),
            ).alias("features"),
        ),
    )
    rows = rows.withColumn("found", seen)
    score = let("v", "f.features", votes(forest, "v"))
    rows = rows.withColumn("found", F.expr(f"transform(found, f -> struct(f.text as text, {score} as score))"))
    return rows.withColumn("found", F.expr(f"transform(found, f -> struct(f.text as text, f.score as score, f.score >= {least}D as secret))"))


def _running(rows: DataFrame, sums: str) -> DataFrame:
    """Turns an array into its sums up to and with each place.

    Each round adds what stands 2 ** k places before, so any number of candidates takes few rounds.
    """
    for k in range(27):
        step = 1 << k
        added = f"transform({sums}, (x, i) -> x + if(i >= {step}, get({sums}, i - {step}), 0))"
        rows = rows.withColumn(sums, F.expr(f"if(size({sums}) > {step}, {added}, {sums})"))
    return rows


def findings(docs: DataFrame, forest: RandomForestClassificationModel) -> DataFrame:
    """The secrets of all documents: doc_id, start (in characters, from 0), length, secret and score.

    Repeated rows have their findings each; those of a row without a doc_id have none. An empty table has none.
    """
    rows = scanned(docs, forest)
    rows = rows.withColumn("hit", settled(F.exists("found", lambda f: f["secret"]))).where("hit")
    # where each candidate ends: all parts and candidates up to it
    rows = rows.select(
        F.col("row.doc_id").alias("doc_id"),
        "found",
        F.expr("zip_with(slice(parts, 1, size(found)), found.text, (p, c) -> length(p) + length(c))").alias("ends"),
    )
    rows = _running(rows, "ends").select("doc_id", F.explode(F.arrays_zip("found", "ends")).alias("one"))
    return rows.where("one.found.secret").select(
        "doc_id",
        (F.col("one.ends") - F.length("one.found.text")).cast("long").alias("start"),
        F.length("one.found.text").cast("long").alias("length"),
        F.col("one.found.text").alias("secret"),
        F.col("one.found.score").alias("score"),
    )


def redacted(docs: DataFrame, forest: RandomForestClassificationModel) -> DataFrame:
    """The documents with each secret replaced by REDACTED, and n_chars, where there is one, to match.

    Documents without secrets stay as they are, null texts too.
    """
    rows = scanned(docs, forest)
    clean = "transform(found, f -> if(f.secret, '" + REDACTED + "', f.text))"
    joined = F.expr(f"array_join(zip_with(parts, concat({clean}, array('')), (p, c) -> p || c), '')")
    rows = rows.withColumn("hit", F.exists("found", lambda f: f["secret"])).withColumn("cleaned", F.when(F.col("hit"), joined))
    kinds = dict(docs.dtypes)
    columns = []
    for name in docs.columns:
        own = F.col("row").getField(name)
        if name == "text":
            own = F.when(F.col("hit"), F.col("cleaned")).otherwise(own)
        elif name == "n_chars":
            own = F.when(F.col("hit"), F.length("cleaned").cast(kinds[name])).otherwise(own)
        columns.append(own.alias(name))
    return rows.select(*columns)


def forest_for(docs: DataFrame) -> RandomForestClassificationModel:
    """A forest trained on the labelled findings that are made for these documents."""
    # written once, as training reads it again and again
    return trained(stored(labelled_findings(docs), "labelled-findings"))
