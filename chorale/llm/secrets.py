"""Secret scans: fixed patterns, and a guess-cost segmentation of values in credential contexts.

Base kinds are patterns (assign, access, hex). The method adds spans of kind `guess`: a value that stands behind a credential word
is cut into words, dates, repeats, keyboard walks, separators and brute-force spans so that the product of their guesses is least,
found by dynamic programming over the end of the last span. A value that takes at least 10^MIN_LOG10 guesses is reported. Base
spans are never changed by it.

Words are priced by their rank in the best of several dictionaries: common passwords and words of placeholders (COMMON), the words
of a public tokenizer's vocabulary in its order, and the LEARNED most frequent words of the documents themselves, counted over all
texts but for values in credential contexts. Ordinary words and what is made of a few of them cost less than a secret does;
measured on labelled values in tests. Repeats of a period up to PERIODS characters are as long as they go and cost what the period
costs and the logarithm of the times; walks over neighbouring keys, or along the alphabet and the digits, may end anywhere.

All positions are code points, ends exclusive. Within a kind, matches are leftmost and don't overlap. Values of any length are
cut in linear time: words and dates have bounded lengths, repeats are found from run lengths, and walks and brute-force spans are
carried on from character to character.

Defined results: null and empty texts have no spans; repeated rows get the same spans each; of segmentations that tie any gives the
same cost. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import documents, id_type, runs, table

KINDS = ("assign", "access", "hex", "guess")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: Guesses, as a power of ten, from which a value counts as a secret.
MIN_LOG10 = 10.0
MIN_VALUE = 6

# (?i:...) with ASCII: other letters that fold to these don't count
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of [0-9a-f]+ matches as a whole or not at all
#: Where the method looks: a credential word, up to 24 word characters, a separator, and a value without white space or quotes.
CONTEXT = re.compile(r"""(?i:passwor[dt]|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)[\w-]{0,24}["']?[ \t]*(?::=|=>|[:=])[ \t]*["']?([^\s"'<>,;]{6,})""", re.ASCII)

#: Common passwords and the words of placeholders, most common first; the rank is the number of guesses.
COMMON = """password your key api token secret here example test value none null true false change changeme redacted placeholder
replace insert enter my the user admin process env environ config settings getenv default dummy sample demo todo fixme undefined
qwerty welcome letmein monkey dragon master login princess football baseball shadow sunshine superman trustno iloveyou batman hello
freedom whatever testing guest root pass access private public auth server client service system account database backup temp
string add this put vault secrets os var xxx abc love summer winter spring autumn january february march april may june july august
september october november december monday tuesday wednesday thursday friday saturday sunday michael jordan jessica charlie andrew
daniel thomas george hunter soccer hockey killer pepper ginger cookie computer internet google office security company project
staging production development local host and for with that from have not are was you""".split()
#: Words that are learned from the documents at most, those with so many occurrences at least, and the longest.
LEARNED, OFTEN, LONGEST = 20_000, 3, 24
#: Different words that a task counts before it passes them on.
COUNTED = 200_000
WORD = re.compile(r"(?<![A-Za-z0-9_+/=.-])[A-Za-z]{3,24}(?![A-Za-z0-9_+/=-])")
LEET = str.maketrans("4301$5@7", "aeoissat")
SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:19|20)\d\d([-_./]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-_./]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d", re.ASCII)
LONGEST_DATE = 10
PERIODS = 8
SEPARATORS = frozenset("-_./:$%{}()[]<>#")
#: What costs are made of, as powers of ten: a new span, a separator, a year and a full date, the first key of a walk and a further one.
BEGIN, SEPARATOR, YEAR, FULL_DATE, WALK, STEP = 0.3, 0.8, 2.1, 4.6, log10(47 * 4), 0.35
FAR = float("inf")


def _near() -> dict[str, str]:
    """Each key's neighbours on a keyboard, the next ones in its row and those above and below."""
    out: dict[str, set[str]] = {}
    for r, row in enumerate(ROWS):
        for c, key in enumerate(row):
            for rr, cc in ((r, c - 1), (r, c + 1), (r - 1, c), (r - 1, c + 1), (r + 1, c - 1), (r + 1, c)):
                if 0 <= rr < len(ROWS) and 0 <= cc < len(ROWS[rr]):
                    out.setdefault(key, set()).add(ROWS[rr][cc])
    return {k: "".join(v) for k, v in out.items()}


NEAR = _near()


def alphabet(value: str) -> int:
    """The number of characters that a brute-force search of the value would try at each place."""
    classes = ((r"[0-9]", 10), (r"[a-z]", 26), (r"[A-Z]", 26), (r"[^0-9A-Za-z]", 33))
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return 16 if re.search(r"[a-fA-F]", value) else 10
    return sum(n for pattern, n in classes if re.search(pattern, value))


def steps(a: str, b: str) -> bool:
    """Whether the key of b is next to that of a, whatever the shift, or b comes after or before a in the alphabet or the digits."""
    p, q = a.translate(SHIFTED), b.translate(SHIFTED)
    return q in NEAR.get(p, "") or a.isalnum() and b.isalnum() and ord(b) - ord(a) in (1, -1)


def ranks(dictionaries: Iterable[list[str]]) -> dict[str, int]:
    """Each word's best rank, from 1."""
    out: dict[str, int] = {}
    for words in dictionaries:
        for k, word in enumerate(words):
            out[word] = min(k + 1, out.get(word, k + 1))
    return out


class Guesser:
    """The least guess cost of values under some ranked dictionaries."""

    def __init__(self, rank: dict[str, int]):
        self.rank = rank
        self.heads = {w[:3] for w in rank if len(w) > 2}
        self.of_period: dict[str, float] = {}

    def words(self, value: str, low: str, i: int) -> Iterator[tuple[int, float]]:
        """Ends and costs of the words that begin at i, plain or with digits for letters."""
        for text, more in ((low[i : i + LONGEST], 0.0), (low[i : i + LONGEST].translate(LEET), 0.3)):
            if text[:3] not in self.heads:
                continue
            for n in range(3, len(text) + 1):
                if (r := self.rank.get(text[:n])) is not None and not (more and text[:n] == low[i : i + n]):
                    upper = sum(map(str.isupper, value[i : i + n]))
                    plain = not upper or upper == n or upper == 1 and value[i].isupper()
                    yield i + n, log10(r + 1) + more + (0.3 * bool(upper) if plain else 0.3 * upper)

    def period(self, value: str) -> float:
        """The cost of a repeat's period."""
        if value not in self.of_period:
            if len(self.of_period) > 1 << 16:
                self.of_period.clear()
            self.of_period[value] = log10(max(alphabet(value), 2)) if len(value) == 1 else self.cost(value)
        return self.of_period[value]

    def cost(self, value: str) -> float:
        """log10 of the fewest guesses over all segmentations of the value."""
        n, low, step = len(value), value.lower(), log10(max(alphabet(value), 2))
        if len(low) != n:
            low = value
        run = {p: [0] * (n + 1) for p in range(1, PERIODS + 1) if p < n}
        for p, lengths in run.items():
            for i in range(n - p - 1, -1, -1):
                if value[i] == value[i + p]:
                    lengths[i] = lengths[i + 1] + 1
        best = [0.0] + [FAR] * n
        brute = one = two = more = FAR  # the last span so far: brute force, or a walk of one, two or more keys
        for i in range(n):
            here = best[i] + BEGIN
            brute = min(brute, here) + step
            near = i > 0 and steps(low[i - 1], low[i])
            one, two, more = here + WALK, one + STEP if near else FAR, min(two, more) + STEP if near else FAR
            best[i + 1] = min(best[i + 1], brute, more, best[i] + SEPARATOR if low[i] in SEPARATORS else FAR)
            for end, c in self.words(value, low, i):
                best[end] = min(best[end], here + c)
            if low[i].isdigit() and (found := DATE.match(low, i, min(n, i + LONGEST_DATE))):
                best[found.end()] = min(best[found.end()], here + (YEAR if found.end() - i == 4 else FULL_DATE))
            for p, lengths in run.items():
                if (times := lengths[i] // p + 1) > 2 or times == 2 and p > 1:
                    end = i + times * p
                    best[end] = min(best[end], here + self.period(value[i : i + p]) + log10(times))
        return best[n]


def vocabulary(path: str) -> list[str]:
    """The words of a byte-level vocabulary file, in its order: tokens of letters that begin behind a space."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    words = (t[1:].lower() for t in sorted(tokens, key=tokens.get) if re.fullmatch(r"\u0120[A-Za-z]{3,24}", t))
    return list(dict.fromkeys(words))


def learned(df: DataFrame, most: int = LEARNED) -> list[str]:
    """The most frequent words of all texts, in order, `most` or somewhat fewer; what stands in credential contexts isn't counted."""
    rows = df.select(F.coalesce("text", F.lit("")).cast("binary").alias("body"))

    def out(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for part in runs(batch, "body"):
                for v in part.column(0):
                    text = v.as_py().decode("utf-8", "replace")
                    seen.update(WORD.findall(CONTEXT.sub(" ", text) if worth(text) else text))
                if len(seen) > COUNTED:
                    yield out(seen)
                    seen.clear()
        yield out(seen)

    counts = table(rows.mapInArrow(counted, "word string, n long").groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN))
    # a thousand steps of frequency at most tell how far down the words are few enough to be collected
    step = F.floor(F.log2("n") * 16)
    left, least = most, None
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: -r.s):
        if (left := left - r.k) < 0:
            break
        least = r.s
    rows_of = counts.where(step >= least).collect() if least is not None else []
    return [r.word for r in sorted(rows_of, key=lambda r: (-r.n, r.word))]


#: Any text that CONTEXT or ASSIGN match has one of these, whatever its case, and a colon or an equals sign.
CLUES = ("passw", "passphrase", "pwd", "secret", "token", "api", "key", "credential", "auth")


def worth(text: str) -> bool:
    """Whether the slow patterns could match at all; plain searches tell, which take a small part of their time."""
    return (":" in text or "=" in text) and any(map(text.lower().__contains__, CLUES))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN] if worth(text) else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def guess_spans(text: str, guesser: Guesser, least: float = MIN_LOG10) -> list[tuple[int, int, int]]:
    if not worth(text):
        return []
    return [(m.start(1), 3, m.end(1)) for m in CONTEXT.finditer(text) if m.end(1) - m.start(1) >= MIN_VALUE and guesser.cost(m[1]) >= least]


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(df: DataFrame, dictionaries: Iterable[list[str]] = (COMMON,), least: float = MIN_LOG10) -> DataFrame:
    """A row for each row of df: doc_id, n_assign, n_access, n_hex, n_guess, base (spans) and spans.

    The dictionaries are sent to the tasks; they are meant to have some tens of thousands of words, as `learned` and `vocabulary` give.
    """
    sent = df.sparkSession.sparkContext.broadcast(ranks(dictionaries))
    rows = df.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("body"))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesser = Guesser(sent.value)
        for batch in batches:
            for part in runs(batch, "body"):
                counts, bases, every = [[], [], [], []], [], []
                for v in part.column(1):
                    text = v.as_py().decode("utf-8", "replace")
                    base, more = base_spans(text), guess_spans(text, guesser, least)
                    spans = sorted(base + more)
                    for k in range(4):
                        counts[k].append(sum(s[1] == k for s in spans))
                    bases.append(named(base))
                    every.append(named(spans))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(bases, pa.string()), pa.array(every, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base", "spans"])

    return rows.mapInArrow(scanned, f"doc_id {id_type(df)}, n_assign long, n_access long, n_hex long, n_guess long, base string, spans string")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir)
    return scan(docs, (COMMON, vocabulary(public_tokenizers.path("byte_bpe_50k.json")), learned(docs)))


def base_columns() -> list:
    return ["doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256")]


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select(*base_columns(), "spans")


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10_secret_scan that SQL can express: all but the spans that the guess cost adds."""
    return scan(documents(spark, sf_dir)).select(*base_columns())


_KEY = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
_PATTERNS = {"assign": _KEY + """["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("\\\\", "\\"), "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
_LENGTH = {"assign": f"length(regexp_extract(m, '{_PATTERNS['assign'].replace(chr(39), chr(39) * 2)}', 2)) >= {MIN_ASSIGN}", "access": f"length(m) >= {MIN_ACCESS}", "hex": f"length(m) >= {MIN_HEX}"}
_SPANS = " union all ".join(
    f"""select doc_id, '{kind}' as kind, {k} as k, s, s + length(m) as e from (
          select doc_id, ms[i] as m, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::bigint as s
          from (select doc_id, ms, gaps, unnest(range(1, len(ms) + 1)) as i from (
            select doc_id, regexp_extract_all(t, '{p}') as ms, string_split_regex(t, '{p}') as gaps from d))) where {_LENGTH[kind]}"""
    for k, kind in enumerate(("assign", "access", "hex"))
    for p in [_PATTERNS[kind].replace("'", "''")]
)
ORACLE: dict[str, str] = {
    # where a match begins: the lengths of what lies between the matches before it, and theirs
    "secret_base_spans": f"""
        with d as (select doc_id, coalesce(text, '') as t from documents), spans as ({_SPANS}),
        told as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
                        string_agg(kind || ':' || s || ':' || e, ',' order by s, k) as base from spans group by doc_id)
        select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256
        from d left join told using (doc_id)"""
}
QUERIES = {"op10_secret_scan": op10_secret_scan, "secret_base_spans": secret_base_spans}
