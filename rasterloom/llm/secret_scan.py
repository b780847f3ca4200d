"""Secret scans: candidates by one pattern, false positives removed by a random forest, in DataFrame functions only.

A candidate is a long run of key characters with a digit or a known prefix, what is assigned to a name like "password" or
"access_key_id", a password or a webhook's path within an address, or a block of a key or certificate. The forest sees its length, its transitions between kinds of characters, how much of it
a dictionary covers (the most frequent whole words of a public vocabulary), whether it stands in a path, and the words beside
it. It is grown on the driver from labelled findings, a small table, and compiled into one column expression; texts are then
searched and redacted inside Spark's own operators.

There are no labelled findings among the public tables, so labelled_findings() makes some by rule. Whoever has real ones (before,
candidate, after, label) passes them to train() instead.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cache

import numpy as np
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import beside

KEY_WORDS = "passw(?:or)?d|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth(?:orization)?|bearer"
PLAIN_WORDS = "commit|sha1|sha256|sha384|sha512|md5|checksum|digest|hash|uuid|guid|revision|build|version|isbn|card|phone|invoice|order|serial|example|placeholder|dummy|sample|image|etag|integrity"
#: Where the dictionary is read from, how many of its words count, and of which lengths.
VOCABULARY, DICTIONARY_WORDS, WORD_LENGTHS = public_tokenizers.path("word_bpe_49k.json"), 4000, (4, 14)
#: What may stand between a key word and its "=": "_id", "_key_base", "KeyId", a plural.
SUFFIX = r"[sS]?(?:[_.\-][A-Za-z0-9_.\-]{1,24}|(?<=[a-z])[A-Z][A-Za-z0-9]{0,23}|(?i:keys?|ids?|value))?"
KNOWN_PREFIX = "(?:AKIA|ASIA|gh[pousr]_|xox[abprs]-|AIza|sk_live_|sk-|eyJ|glpat-)"
SCHEME = "(?i:bearer|basic|token)"
#: Up to the END line; where there is none (or another block starts first), header lines and lines of base64.
BLOCK = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----(?:[^\-]*+(?:-(?!----(?:BEGIN|END) )[^\-]*+)*+-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
    r"|(?:\s++[A-Za-z][A-Za-z\-]*+: [^\n]*+)*+(?:(?:\s|\\[rn])++[A-Za-z0-9+/]{16,}+={0,2})*+(?:(?<=[A-Za-z0-9+/]{16})\r?\n[A-Za-z0-9+/]{1,15}+={0,2}(?=\s*(?:\n|$)))?)"
)
#: A whole block of what is public: a certificate, a public key. It is one candidate, so that its lines aren't each one.
PUBLIC = r"-----BEGIN (?![A-Z ]*PRIVATE)[A-Z0-9 ]++-----[^\-]*+(?:-(?!----)[^\-]*+)*+-----END [A-Z0-9 ]++-----"
#: Passwords in addresses, and the paths of webhooks, which are their only protection.
IN_ADDRESS = r"(?<=://[^\s:/@]{1,64}:)[^\s/@\"'<>]{4,}(?=@[A-Za-z0-9\[])"
WEBHOOK = r"(?<=hooks\.slack\.com/(?:services|workflows)/|discord(?:app)?\.com/api/webhooks/|webhook\.office\.com/webhookb2/)[A-Za-z0-9_\-@/]{20,}"
#: What people put where a secret would stand.
STAND_IN = r"(?i)change|example|your|xxx|\*\*|placeholder|none|required|dummy|sample|todo|\$\{|<|redact|secret|passw|token|test|default|hidden|insert|replace"
CANDIDATE = (
    # what each branch begins with is implied by what follows and spares that at most places
    rf"(?=-----BEGIN )(?:{BLOCK}|{PUBLIC})|(?<=[:/])(?:{IN_ADDRESS}|{WEBHOOK})|(?<=[=:][ \t]{{0,2}}[\"']{{0,1}}(?:{SCHEME}[ \t]{{1,2}}){{0,1}})(?<=(?i:{KEY_WORDS}){SUFFIX}[\"']{{0,1}}[ \t]{{0,2}}[=:][ \t]{{0,2}}[\"']{{0,1}}(?:{SCHEME}[ \t]{{1,2}}){{0,1}})(?!{SCHEME}[ \t])[^\s\"'<>=:,;]{{6,}}={{0,2}}"
    rf"|(?<![A-Za-z0-9+/_\-])(?!com/(?:services|workflows|api/webhooks|webhookb2)/)(?={KNOWN_PREFIX}|[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{{16,}}={{0,2}}"
)
#: A text without these has no candidate.
HINT = rf"[0-9]|-----BEGIN|{KNOWN_PREFIX}|(?i:{KEY_WORDS}){SUFFIX}[\"']?[ \t]{{0,2}}[=:]|://[^\s:/@]{{1,64}}:|webhook|hooks\."
BEFORE, AFTER = 48, 24
MASK = "[secret]"
#: Parts of the names that harmless findings are made of.
NAMES = (
    "acl agent archive asset axis bin blob bridge bucket bundle byte callback canvas catalog cell chart chunk codec cookie cron cursor daemon delta digest dispatch dump edge encoder endpoint epoch fetch fixture flag fork "
    "gauge glob grid guard hook icon inbox ingest jar job kernel knob lambda ledger lint locale lookup macro manifest merge mock mutex nav node npm opcode outbox parser patch pixel plugin probe proxy query queue quota "
    "raster regex render repo resolver retry route runner sandbox scan schema scope seed shard shell sidebar slot socket span stack stub sync task tenant thread token track tuple unit upload vault vendor view vue watch widget window worker xml yaml yield zone zoom"
).split()
FEATURES = ("length", "transitions", "digits", "upper", "distinct", "hexadecimal", "repeats", "dictionary", "path", "in_path", "key_word", "plain_word", "assigned", "block", "known_prefix", "public", "in_address", "webhook", "stand_in")
TREES, DEPTH, SEED, FINDINGS = 25, 6, 11, 3000


@cache
def dictionary(path: str = VOCABULARY) -> tuple[str, ...]:
    """The first DICTIONARY_WORDS whole words (letters a to z) of a vocabulary with word ends, most frequent first."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    low, high = WORD_LENGTHS
    whole = (t[:-4] for t, _ in sorted(vocab.items(), key=lambda x: x[1]) if t.endswith("</w>"))
    words = [w for w in whole if low <= len(w) <= high and w.isascii() and w.isalpha() and w.islower()]
    return tuple(words[:DICTIONARY_WORDS])


def features(candidate: Column, before: Column, after: Column, words: tuple[str, ...]) -> Column:
    """A struct of FEATURES, doubles; words are those of the dictionary."""
    n = F.length(candidate).cast("double")
    low = F.lower(candidate)
    turn = r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])|(?<=[A-Za-z0-9])(?=[^A-Za-z0-9])"
    runs = F.split(candidate, r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
    covered = F.aggregate(F.filter(runs, lambda w: F.lower(w).isin(*words)), F.lit(0), lambda total, w: total + F.length(w))
    values = {
        "length": n,
        "transitions": F.regexp_count(candidate, F.lit(turn)) / n,
        "digits": F.regexp_count(candidate, F.lit("[0-9]")) / n,
        "upper": F.regexp_count(candidate, F.lit("[A-Z]")) / n,
        "distinct": F.size(F.array_distinct(F.split(candidate, ""))) / n,
        "hexadecimal": low.rlike("^[0-9a-f]+$"),
        "repeats": F.regexp_count(candidate, F.lit(r"(.)\1+")) / n,
        "dictionary": covered / n,
        "path": F.regexp_count(candidate, F.lit("[/_-]")) / n,
        "in_path": before.rlike(r"(?:://|/|\\)\S*$") | after.rlike(r"^(?:\.[a-z]{2,4}\b|/)"),
        "key_word": before.rlike(rf"(?i:{KEY_WORDS}){SUFFIX}[^A-Za-z]{{0,6}}(?:{SCHEME}[ \t]{{1,2}})?$"),
        "plain_word": before.rlike(rf"(?i)\b(?:{PLAIN_WORDS})\b[^\n]{{0,16}}$") | candidate.rlike(r"^(?i:sha(?:1|224|256|384|512)|md5)[\-:_]"),
        "assigned": before.rlike(r"[=:][ \t]*[\"']?$"),
        "block": candidate.rlike("^-----BEGIN [A-Z ]*PRIVATE"),
        "known_prefix": candidate.rlike(f"^{KNOWN_PREFIX}"),
        "public": candidate.rlike("^-----BEGIN (?![A-Z ]*PRIVATE)"),
        "in_address": before.rlike(r"://[^\s:/@]{1,64}:$") & after.startswith("@"),
        "webhook": before.rlike(r"(?:hooks\.slack\.com/(?:services|workflows)|/api/webhooks|/webhookb2)/$"),
        "stand_in": candidate.rlike(STAND_IN),
    }
    return F.struct(*(values[k].cast("double").alias(k) for k in FEATURES))


def labelled_findings(spark: SparkSession, rows: int = FINDINGS, seed: int = SEED) -> DataFrame:
    """(before, candidate, after, label): findings made by rule, from a fixed seed, half of them secrets.

    The names in harmless ones are put together from NAMES, whether the dictionary has them or not.
    """
    draw = np.random.default_rng(seed)
    hexa, upper, base = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    safe = base[:-2] + "_-"
    common = dictionary()[::8]

    def some(letters: str, n: int) -> str:
        return "".join(letters[i] for i in draw.integers(0, len(letters), n))

    def pick(*of: str) -> str:
        return of[int(draw.integers(len(of)))]

    def name() -> str:
        return pick("_", "-", "/").join(pick(*NAMES) for _ in range(int(draw.integers(2, 5)))) + str(draw.integers(1, 100))

    def words() -> str:
        return " ".join(some("abcdefghijklmnopqrstuvwxyz", int(draw.integers(2, 9))) for _ in range(4)) + " "

    def spoken() -> str:
        """A password as people make them: words, digits and marks."""
        parts = [pick(*NAMES, *common) for _ in range(int(draw.integers(1, 4)))]
        parts = [w.capitalize() if draw.integers(2) else w for w in parts]
        return pick("", "", ".", "_").join(parts) + str(draw.integers(1, 10000)) + pick("", "", "!", "$", "#1", "@2x")

    def identifier() -> str:
        """A name in a program: words in capitals, with or without a number."""
        parts = [pick(*NAMES, *common) for _ in range(int(draw.integers(3, 7)))]
        return pick("get", "set", "is", "on", "") + "".join(w.capitalize() for w in parts) + pick("", str(draw.integers(1, 100)))

    def secret() -> tuple[str, str, str]:
        key = pick("password=", "passwd: ", 'token = "', 'secret = "', "api_key=", "API_KEY: ", 'access_key="', "Authorization: Bearer ", "PASSWORD=", 'TOKEN = "', "pwd=")
        kind = int(draw.integers(10))
        if kind == 7:
            return words() + pick("DB_PASSWORD=", "DATABASE_PASSWORD=", "password: ", "MYSQL_PWD=", "passwd = ", 'pass_phrase_secret="', "SMTP_PASSWORD: "), spoken(), pick("\n", " ", '"')
        if kind == 8:
            user = pick("root", "admin", "app", "postgres", pick(*NAMES))
            return words() + pick("mysql", "postgres", "https", "amqp", "redis", "mongodb+srv") + f"://{user}:", pick(spoken().replace("@", "-"), pick(*common).capitalize() + pick("-", "+", "_") + spoken().replace("@", "-"), some(safe, int(draw.integers(8, 30)))), "@" + pick("localhost", "db.internal:5432/app", "host", "10.0.0.5")
        if kind == 9:
            if draw.integers(2):
                return words() + "https://hooks.slack.com/services/", f"T{some(upper, 8)}/B{some(upper, 8)}/{some(safe[:-2], 24)}", " "
            return words() + "https://discord.com/api/webhooks/", f"{some('0123456789', 18)}/{some(safe, 60)}", " "
        if kind == 0:
            return words() + pick("", "aws ", "key "), pick("AKIA", "ASIA") + some(upper, 16), " "
        if kind == 1:
            return words(), pick("ghp_", "xoxb-", "AIza", "sk_live_", "glpat-") + some(safe, int(draw.integers(24, 40))), " "
        if kind == 2:
            return words(), "eyJ" + some(safe, int(draw.integers(40, 90))), "."
        if kind == 3:
            named = pick("PRIVATE KEY", "RSA PRIVATE KEY", "EC PRIVATE KEY", "PGP PRIVATE KEY BLOCK")
            headers = pick("", "", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,AB\n\n")
            return words(), f"-----BEGIN {named}-----\n{headers}{some(base, 64)}" + pick("", f"\n-----END {named}-----"), "\n"
        value = some(hexa, int(draw.integers(12, 65))) if kind < 6 else some(safe, int(draw.integers(10, 44)))
        return words() + key, value.upper() if key.isupper() else value, pick('"', " ", "\n", '"!!')

    def harmless() -> tuple[str, str, str]:
        kind = int(draw.integers(14))
        if kind == 9:
            named = pick("CERTIFICATE", "PUBLIC KEY", "RSA PUBLIC KEY", "CERTIFICATE REQUEST", "PGP PUBLIC KEY BLOCK", "PGP SIGNATURE")
            return words(), f"-----BEGIN {named}-----\n{some(base, 64)}\n{some(base, 64)}\n-----END {named}-----", "\n"
        if kind == 10:
            return words() + pick('integrity="', "", "sri: ", "resolved "), pick("sha512-", "sha384-", "sha256-", "sha256:") + some(base, int(pick("43", "64", "86"))) + pick("==", "=", ""), pick('"', " ")
        if kind in (11, 12):
            return words() + pick("", "call ", "= ", "var ", "function "), identifier() + str(draw.integers(10)), pick("(", " ", ";", ".")
        if kind == 13:
            user = pick("user", "admin", "username")
            return words() + f"postgres://{user}:", pick("password", "changeme", "secret1", "example", "yourpassword", "${PASSWORD}", "xxxxx"), "@" + pick("localhost", "host")
        if kind == 0:
            h = some(hexa, 32)
            return words() + pick("", "id=", "uuid: ", "guid "), "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:])), " "
        if kind == 1:
            return words() + pick("commit ", "sha1: ", "sha256:", "revision ", "md5 ", "checksum: ", "digest="), some(hexa, int(pick("32", "40", "64"))), " "
        if kind == 2:
            return words() + pick("", "card ", "order ", "number "), some("0123456789", int(draw.integers(16, 25))), " "
        if kind == 3:
            return words() + pick("/usr/", "src/", "https://example.com/", ""), (name() + "/" + name() + name())[:60], pick(".py", ".html", "/", " ")
        if kind == 4:
            return words() + pick("password=", "token: ", 'secret="', "api_key = "), pick("changeme", "xxxxxxxx", "********", "your_password", "<password>"[1:-1], "example", "placeholder", "${PASSWORD}", "none-here", "required") + pick("", "1", "123"), " "
        if kind == 5:
            return words() + pick("", "= ", ": "), name() + "_" + name(), " "
        if kind == 6:
            return words(), pick("_", "-", "=")[0:0] + pick("0", "1", "a1", "x0") * int(draw.integers(10, 20)), " "
        if kind == 7:
            return words() + pick("image/png;base64,", "integrity sha256-", "etag: "), some(base, int(draw.integers(24, 80))), " "
        return words() + pick("", "on ", "at "), f"{draw.integers(1990, 2030)}-{draw.integers(10, 13)}-{draw.integers(10, 29)}" + pick("-", "_") + pick(*NAMES) + "-" + str(draw.integers(10)), " "

    made = [(*(secret() if i % 2 else harmless()), i % 2) for i in range(rows)]
    rows_json = json.dumps([dict(zip(("before", "candidate", "after", "label"), m, strict=True)) for m in made])
    kind = "array<struct<before:string,candidate:string,after:string,label:int>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows_json), kind)))


Tree = tuple  # (share,) or (feature, cut, below, above)


@dataclass(frozen=True)
class Forest:
    trees: tuple[Tree, ...]
    words: tuple[str, ...]  # the dictionary


def grow(x: np.ndarray, y: np.ndarray, draw, depth: int) -> Tree:
    if depth == 0 or len(y) < 4 or y.min() == y.max():
        return (float((y.sum() + 0.5) / (len(y) + 1)),)
    best = None
    for j in draw.choice(x.shape[1], size=max(2, int(np.sqrt(x.shape[1])) + 1), replace=False):
        order = np.argsort(x[:, j], kind="stable")
        v, s = x[order, j], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if len(cut):
            n = cut + 1.0
            a, b = s[cut] / n, (s[-1] - s[cut]) / (len(y) - n)
            impurity = n * a * (1 - a) + (len(y) - n) * b * (1 - b)
            k = int(impurity.argmin())
            if best is None or impurity[k] < best[0]:
                best = (impurity[k], int(j), float((v[cut[k]] + v[cut[k] + 1]) / 2))
    if best is None:
        return (float((y.sum() + 0.5) / (len(y) + 1)),)
    _, j, at = best
    below = x[:, j] <= at
    return j, at, grow(x[below], y[below], draw, depth - 1), grow(x[~below], y[~below], draw, depth - 1)


def fit(x: np.ndarray, y: np.ndarray, words: tuple[str, ...], seed: int = SEED) -> Forest:
    """Trees on bootstrap samples, each split over a few features drawn anew."""
    draw = np.random.default_rng(seed)
    samples = (draw.integers(0, len(y), len(y)) for _ in range(TREES if len(y) else 0))
    return Forest(tuple(grow(x[i], y[i], draw, DEPTH) for i in samples), words)


def train(findings: DataFrame, vocabulary: str = VOCABULARY) -> Forest:
    """A forest from (before, candidate, after, label); the findings are a small table, checked and labelled by hand or rule."""
    words = dictionary(vocabulary)
    rows = findings.select(features(F.col("candidate"), F.col("before"), F.col("after"), words).alias("f"), "label").select("f.*", "label").collect()
    rows = sorted(tuple(r) for r in rows)
    return fit(np.array([r[:-1] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r[-1] for r in rows], float), words)


def compiled(forest: Forest, of: Column) -> Column:
    """The mean of the trees' shares for a struct of features."""

    def branch(tree: Tree) -> Column:
        if len(tree) == 1:
            return F.lit(tree[0])
        j, cut, below, above = tree
        return F.when(of[FEATURES[j]] <= cut, branch(below)).otherwise(branch(above))

    total = F.lit(0.0)
    for tree in forest.trees:
        total = total + branch(tree)
    return total / max(len(forest.trees), 1)


def scan(docs: DataFrame, forest: Forest, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The columns of docs with the text's secrets masked, n_candidates, and secrets: [(secret, score)] in the text's order.

    What is a secret at one place of a text is masked at all its places there.
    A null text stays null and an empty one empty, both without candidates. Long texts are searched whole. Null ids, ties and
    repeated rows pass through. Columns named n_candidates or secrets, in any case, are replaced, all others stay. An empty
    table gives an empty result.
    """
    own, t, back = beside(docs, text, "n_candidates", "secrets")
    nothing = F.array().cast("array<string>")
    step = own.withColumn("found", F.when(F.col(t).rlike(HINT), F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0))).otherwise(nothing))
    step = step.withColumn("parts", F.when(F.size("found") > 0, F.split(F.col(t), CANDIDATE, -1)).otherwise(nothing))

    def seen(c: Column, i: Column) -> Column:
        before, after = F.get("parts", i), F.get("parts", i + 1)
        return F.struct(c.alias("c"), features(c, F.right(before, F.lit(BEFORE)), F.left(after, F.lit(AFTER)), forest.words).alias("f"))

    step = step.withColumn("seen", F.transform("found", seen))
    step = step.withColumn("seen", F.transform("seen", lambda s: F.struct(s.c.alias("secret"), compiled(forest, s.f).alias("score"))))
    step = step.withColumn("known", F.array_distinct(F.transform(F.filter("seen", lambda s: s.score >= threshold), lambda s: s.secret)))
    masked = F.transform("seen", lambda s: F.when(F.array_contains("known", s.secret), F.lit(MASK)).otherwise(s.secret))
    joined = F.concat(F.get("parts", F.lit(0)), F.array_join(F.zip_with(masked, F.slice("parts", F.lit(2), F.size("found")), lambda a, b: F.concat(a, b)), ""))
    secrets = F.filter("seen", lambda s: F.array_contains("known", s.secret))
    step = step.withColumn("secrets", secrets).withColumn("n_candidates", F.size("found").cast("long"))
    step = step.withColumn(t, F.when(F.size("secrets") > 0, joined).otherwise(F.col(t)))
    return step.select(*back, "n_candidates", "secrets")
