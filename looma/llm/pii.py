"""Personal data by weak supervision.

Every text is scanned once for spans that may be personal data: the four base patterns, their failing matches, and looser
forms (obfuscated addresses, local telephone numbers, bank accounts, social security numbers). Regex, gazetteer and
context labelers vote on each (+1, 0, -1). Spark counts the votes by pattern over all documents; the table of patterns has
a fixed bound (kinds x 3^labelers x forms of a span), so the driver runs expectation-maximisation on it: it estimates how reliable
each labeler is and how likely each pattern is personal, and a logistic span classifier is trained on those posteriors.
Base spans always stay; the classifier adds valid candidates that overlap none of them. A span that fails its check (sum,
number of digits) is evidence for the labelers, never a finding.

Defined results: a null text counts as empty; repeated rows stay; an empty table trains nothing and gives no rows; other
columns are ignored. Offsets are code points. Scans are linear in the text, whatever it holds.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table, written

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
LABELERS = ("regex", "gazetteer", "cue", "counter_cue", "standing")
#: A candidate beside the base spans is personal from this probability on.
THRESHOLD = 0.9

# Patterns and gazetteers.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
VEILED = re.compile(r"\b([A-Za-z0-9._%+-]{1,64}) ?[\[({] ?(?:at|AT) ?[\])}] ?([A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[({] ?(?:dot|DOT) ?[\])}] ?)[A-Za-z0-9-]{1,63}){1,4})")
VEIL = re.compile(r"[\[({] ?(?:at|AT) ?[\])}]")
RUN = re.compile(r"(?<![0-9])[0-9]{13,16}(?![0-9])")
NATIONAL = re.compile(r"(?<![0-9+.)(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
TLDS = frozenset("com org net edu gov mil int info biz io de fr es uk it nl eu ch at be us ca au jp cn in br ru pl se no dk fi pt mx ar".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "62", "81", "82", "86", "90", "91")
IBAN_LENGTH = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
CUES = {
    "email": re.compile(r"e-?mail|contact|write to|correo|courriel|schreib|@", re.I),
    "ip": re.compile(r"\bip\b|address|host|login|client|adresse", re.I),
    "card": re.compile(r"card|visa|master|amex|karte|carte|tarjeta|payment", re.I),
    "phone": re.compile(r"tel|phone|call|fax|mobile|cell|whatsapp|anruf|appel|llam", re.I),
    "iban": re.compile(r"iban|account|konto|compte|cuenta|bank", re.I),
    "ssn": re.compile(r"ssn|social|security|insurance|sozial", re.I),
}
COUNTER = re.compile(r"version|isbn|issn|invoice|order|token|secret|key|hash|sha|md5|uuid|serial|build|section|fig", re.I)
WINDOW, SEPARATED = 32, "n-.bm"


def emails(text: str):
    """Leftmost non-overlapping matches of local@domain, found from each @ outwards."""
    last, at = 0, text.find("@")
    while at >= 0:
        if m := DOMAIN.match(text, at + 1):
            start = at
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                last = m.end()
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    twice = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    d = [ord(c) - 48 for c in digits[::-1]]
    return (sum(d[::2]) + sum(twice[x] for x in d[1::2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return IBAN_LENGTH.get(s[:2], len(s)) == len(s) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def candidates(text: str) -> list[tuple[int, int, int, bool, bool]]:
    """(kind, start, end, base, valid) of every span that may be personal; base: it is one of the fixed patterns' valid matches."""
    found = []
    if "@" in text:
        found += [(0, s, e, True, True) for s, e in emails(text)]
    for m in IP.finditer(text) if text.count(".") >= 3 else ():
        ok = all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))
        found.append((1, m.start(), m.end(), ok, ok))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19:
            found.append((2, m.start(), m.end(), ok := luhn(d), ok))
    for m in PHONE.finditer(text) if "+" in text else ():
        ok = 9 <= len(_digits(m[0])) <= 15
        found.append((3, m.start(), m.end(), ok, ok))
    if VEIL.search(text):
        found += [(0, m.start(), m.end(), False, True) for m in VEILED.finditer(text)]
    found += [(2, m.start(), m.end(), False, luhn(m[0])) for m in RUN.finditer(text)]
    found += [(3, m.start(), m.end(), False, True) for m in NATIONAL.finditer(text)]
    found += [(5, m.start(), m.end(), False, m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000") for m in SSN.finditer(text)]
    found += [(4, m.start(), m.end(), False, _iban(m[0])) for m in IBAN.finditer(text)]
    return found


def votes(text: str, kind: int, start: int, end: int, valid: bool) -> str:
    """One character for each labeler: + for, - against, 0 no vote; then what the classifier sees of the span itself: how its
    parts are separated, whether it begins a line, and the number of its digits, in threes."""
    span, name = text[start:end], KINDS[kind]
    digits = _digits(span)
    left = text[max(0, start - WINDOW) : start]
    gazetteer = {
        "email": lambda: "+" if re.split(r"[^A-Za-z]+", span)[-1].lower() in TLDS else "-",
        "ip": lambda: "-" if span.startswith(("0.", "127.", "255.")) else "+",
        "card": lambda: "+" if digits[0] in "3456" and len(digits) >= 14 else "-",
        "phone": lambda: "+" if not span.startswith("+") or digits.startswith(CALLING) else "-",
        "iban": lambda: "+" if span[:2] in IBAN_LENGTH else "-",
        "ssn": lambda: "0",
    }[name]()
    around = text[start - 1 : start] + text[end : end + 1]
    glued = any(c.isalnum() or c in "_=/#" for c in around)
    return ("+" if valid else "-") + gazetteer + ("+" if CUES[name].search(left) else "0") + ("-" if COUNTER.search(left) else "0") + ("-" if glued else "+") + _separated(span) + ("l" if not left or left[-1] == "\n" else "i") + str(min(9, len(digits) // 3))


def _separated(span: str) -> str:
    """The one sign that separates the parts of a span, n for none, m for several."""
    signs = set(span) & set("-. ()")
    return "n" if not signs else "m" if len(signs) > 1 else {" ": "b", "(": "m", ")": "m"}.get(next(iter(signs)), next(iter(signs)))


def clear_of(base: list[tuple], loose: list[tuple]) -> list[tuple]:
    """Of the spans loose, (start, end, ...), those that overlap none of base, by start. Base spans are merged, so one search decides."""
    starts, ends = [], []
    for start, end in sorted(x[:2] for x in base):
        if starts and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    out = []
    for x in sorted(loose):
        i = bisect.bisect_left(starts, x[1]) - 1
        if i < 0 or ends[i] <= x[0]:
            out.append(x)
    return out


def leftmost(spans: list[tuple]) -> list[tuple]:
    """Of spans by start, each that begins after the last one taken has ended."""
    out, at = [], -1
    for x in spans:
        if x[0] >= at:
            out.append(x)
            at = x[1]
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (kind:start:end), loose (kind:start:end:votes, clear of base) and patterns of all candidates."""

    def make():
        def one(text: str | None):
            text = text or ""
            base, loose, seen, n = [], [], [], [0, 0, 0, 0]
            for kind, start, end, is_base, valid in candidates(text):
                vote = votes(text, kind, start, end, valid)
                seen.append(f"{KINDS[kind]}:{vote}")
                if is_base:
                    n[kind] += 1
                    base.append((start, end, kind))
                elif valid:
                    loose.append((start, end, kind, vote))
            loose = [f"{KINDS[k]}:{s}:{e}:{v}" for s, e, k, v in clear_of(base, loose)]
            return n, [f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted((s, k, e) for s, e, k in base)], loose, seen

        def run(batch: pa.RecordBatch) -> dict:
            rows = [one(t) for t in batch.column(1).to_pylist()]
            counts = {f"n_{KINDS[k]}": pa.array([r[0][k] for r in rows], pa.int64()) for k in range(4)}
            lists = {c: pa.array([r[i] for r in rows], pa.list_(pa.string())) for i, c in ((1, "base"), (2, "loose"), (3, "patterns"))}
            return {"doc_id": batch.column(0)} | counts | lists

        return run

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base array<string>, loose array<string>, patterns array<string>"
    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), make, schema)


def fit(pattern_counts: list[tuple[str, int]], rounds: int = 30) -> dict[str, float]:
    """Probability of each pattern: EM over the labelers' votes, then the span classifier trained on its posteriors."""
    if not pattern_counts:
        return {}
    names, n = [p for p, _ in pattern_counts], np.array([c for _, c in pattern_counts], float)
    kinds = np.array([KINDS.index(p.partition(":")[0]) for p in names])
    v = np.array([[{"+": 1, "0": 0, "-": -1}[c] for c in p.partition(":")[2][: len(LABELERS)]] for p in names], float)
    right = np.array([0.95, 0.75, 0.8, 0.8, 0.8])  # chance that a vote is right, at first
    prior = np.full(len(KINDS), 0.7)
    for _ in range(rounds):
        logit = np.log(prior / (1 - prior))[kinds] + v @ np.log(right / (1 - right))
        post = 1 / (1 + np.exp(-logit))
        for j in range(len(LABELERS)):
            cast = v[:, j] != 0
            agree = np.where(v[cast, j] > 0, post[cast], 1 - post[cast])
            right[j] = (agree @ n[cast] + 8 * 0.8) / (n[cast].sum() + 8)
        right = right.clip(0.55, 0.99)
        for k in set(kinds):
            own = kinds == k
            prior[k] = (post[own] @ n[own] + 3) / (n[own].sum() + 5)
        prior = prior.clip(0.05, 0.95)
    digits = np.array([int(p[-1]) for p in names])
    own = np.array([[p[-3] == c for c in SEPARATED] + [p[-2] == "l"] for p in names], float)
    x = np.hstack([np.eye(len(KINDS))[kinds], (v > 0), (v < 0), np.eye(10)[digits] * 0.3, own * 0.3]).astype(float)
    w, weight = np.zeros(x.shape[1]), np.sqrt(n) / np.sqrt(n).sum()
    for step in range(400):
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= 4 * (x.T @ (weight * (p - post)) + 1e-4 * w)
    return dict(zip(names, 1 / (1 + np.exp(-(x @ w))), strict=True))


def learn(scanned: DataFrame) -> dict[str, float]:
    """The classifier as a probability for each pattern of votes. At most kinds x 3^labelers x 100 patterns exist."""
    counts = scanned.select(F.explode("patterns").alias("p")).groupBy("p").count()
    return fit(sorted((r["p"], r["count"]) for r in counts.collect()))


def find(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_*, base and added (arrays of kind:start:end) of every row of docs(doc_id, text)."""
    scanned = written(scan(docs), "pii")
    personal = frozenset(p for p, x in learn(scanned).items() if x >= threshold)

    def make():
        def chosen(loose: list[str]) -> list[str]:
            spans = [(int(s), int(e), kind) for kind, s, e, vote in (x.split(":", 3) for x in loose) if f"{kind}:{vote}" in personal]
            return [f"{kind}:{s}:{e}" for s, e, kind in leftmost(spans)]

        def run(batch: pa.RecordBatch) -> dict:
            held = {c: batch.column(c) for c in batch.schema.names if c != "loose"}
            return held | {"added": pa.array([chosen(x) for x in batch.column("loose").to_pylist()], pa.list_(pa.string()))}

        return run

    counts = "n_email long, n_ip long, n_card long, n_phone long"
    return map_batches(scanned.drop("patterns"), make, f"doc_id long, {counts}, base array<string>, added array<string>")


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; n_chars follows where docs has it. The text is scanned
    again rather than joined, so no text is shuffled."""
    personal = frozenset(p for p, x in learn(written(scan(docs).select("patterns"), "pii-patterns")).items() if x >= threshold)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        base, loose = [], []
        for kind, start, end, is_base, valid in candidates(text):
            if is_base:
                base.append((start, end, kind))
            elif valid and f"{KINDS[kind]}:{votes(text, kind, start, end, valid)}" in personal:
                loose.append((start, end, kind))
        spans = sorted(base + leftmost(clear_of(base, loose)))
        out, at = [], 0
        for start, end, kind in spans:
            if start >= at:
                out += [text[at:start], f"<{KINDS[kind]}>"]
            at = max(at, end)
        return "".join([*out, text[at:]]) if spans else text

    names, where = docs.columns, docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = pa.array([clean(t) for t in part.column(where).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([texts if i == where else part.column(i) for i in range(len(names))], names=names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def _order(span):
    """Sort key of kind:start:end: start, then the kind as listed."""
    part = F.split(span, ":")
    return F.struct(F.element_at(part, 2).cast("long").alias("s"), F.array_position(F.array(*map(F.lit, KINDS)), F.element_at(part, 1)).alias("k"), span.alias("t"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    everything = F.transform(F.array_sort(F.transform(F.concat("base", "added"), _order)), lambda x: x["t"])
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.array_join("base", ",").cast("binary"), 256).alias("base_sha256"), F.array_join(everything, ",").alias("spans"), F.size("added").cast("long").alias("n_added"))
