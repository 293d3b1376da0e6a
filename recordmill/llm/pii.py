"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

1. Patterns give candidates: the four base kinds, which are spans by definition, and others (dates of
   birth, account numbers, social security numbers, spelled-out addresses, names after a title or that
   begin with a listed given name). Those that touch a base span fall away; of others that touch, the
   first stays, and of those that begin together the longest.
2. Four labelers vote on each candidate: its pattern's own check, a gazetteer, the words before it, and
   what touches it. A vote is 1 (personal), -1 (not) or 0 (no opinion).
3. The counts of vote patterns, a table of bounded size, go to the driver. Expectation-maximisation
   estimates each labeler's reliability and each pattern's posterior, and a logistic classifier over
   votes, kind and shape is trained on the posteriors.
4. Candidates of other kinds that the classifier takes become spans beside the base ones.

Places count code points; ends are exclusive. Defined results: a null text counts as empty; with no
candidates only the prior decides, so nothing is added; repeated rows each get their row; extra columns
are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.llm.common import table

BASE_KINDS = ("email", "ip", "card", "phone")
OTHER_KINDS = ("account", "birth", "name", "spelled", "ssn")
VOTES = ("check", "gazetteer", "context", "touch")

# The base patterns; possessive or anchored forms find the same and take linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

OTHER = {
    "account": re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b"),
    "birth": re.compile(r"\b(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})\b"),
    "name": re.compile(r"\b(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20)?[A-Z][a-z]{1,20}(?:\x20[A-Z][a-z]{1,20})?\b"),
    "spelled": re.compile(r"\b[A-Za-z0-9._-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}\x20?[\[(](?:dot|DOT)[\])]\x20?[A-Za-z]{2,10}\b"),
    "ssn": re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
}
# Where a name can begin, a title or a given name before another capital; frequent given names of four languages.
TITLE = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20(?=[A-Z][a-z])")
CAPITAL = re.compile(r"\b[A-Z][a-z]{1,20}(?=\x20[A-Z][a-z])")
NAMES = frozenset(
    "Adam Alan Albert Alejandro Alexander Alice Amanda Amy Ana Andrea Andreas Andrew Angela Anja Ann Anna Anne Anthony Antoine Antonio Barbara Ben Benjamin Bernd "
    "Brian Carlos Carmen Carol Catherine Charles Charlotte Christian Christine Christopher Claire Claudia Daniel David Deborah Diego Dieter Donald Dorothy Edward "
    "Elena Elizabeth Emily Emma Eric Eva Fernando Florian Francisco Frank Gabriel George Hannah Hans Harry Heather Heinz Helen Henri Henry Inge Isabel Isabelle Jack "
    "Jacques James Jan Jane Javier Jean Jeffrey Jennifer Jessica Joan Johanna John Jonathan Jorge Jose Joseph Juan Julia Julie Karen Karin Katharina Kevin Klaus Laura "
    "Lena Linda Lisa Louis Lucas Luis Luisa Manuel Marc Margaret Maria Marie Mark Markus Martin Mary Matthew Max Michael Michel Miguel Monika Nancy Nathalie Nicolas "
    "Olivia Pablo Patricia Patrick Paul Paula Pedro Peter Philippe Pierre Rachel Rafael Ralf Rebecca Richard Robert Rosa Ruth Samuel Sandra Sara Sarah Sergio Silvia "
    "Simon Sofia Sophie Stefan Stephen Steven Susan Sylvie Teresa Thomas Tim Timothy Ursula Uwe Victor William Wolfgang".split()
)
# Endings of domains, countries with IBANs, and the calling codes of one and two digits and the zones that have three.
ENDINGS = frozenset("at au be biz br ca ch cn co com cz de dk edu es eu fi fr gov ie in info int io it jp kr me mil mx net nl no nz org pl pt ru se tr tv uk us za".split())
COUNTRIES = frozenset(
    "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA VA VG XK".split()
)
CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
ZONES = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
FOR = re.compile(r"(?i)\b(?:e-?mail|mail|contact|reach|phone|tel|call|mobile|fax|ip|host|card|visa|iban|account|konto|compte|ssn|social security|born|birth|dob|name|dear)\b")
AGAINST = re.compile(r"(?i)\b(?:version|v|release|isbn|issn|doi|sku|figure|table|section|example|copyright|page)\b")
CONTEXT = 40
#: Log odds of a vote at the start of an estimate in which abstentions are no evidence: 0.95.
SURE = 3.0
SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<string>, found array<struct<kind:string,s:int,e:int,v:array<int>,shape:int>>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every match of local@domain, leftmost first: only places of @ are looked at."""
    pos, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            pos = m.end()
        at = text.find("@", max(at + 1, pos))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE_KINDS}
    if "@" in text:
        out["email"] = list(_emails(text))
    out["ip"] = [m.span() for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def _names(text: str) -> Iterator[tuple[int, int]]:
    """A title or a known given name, and the capitalised words after it, two with a title, one without."""
    for start in sorted({m.start() for m in TITLE.finditer(text)} | {m.start() for m in CAPITAL.finditer(text) if m[0] in NAMES}):
        if m := OTHER["name"].match(text, start):
            yield m.span()


def other_spans(text: str, taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Candidates of the other kinds that touch none of ``taken`` nor each other: by start, the longer first, then by kind."""
    found = [(s, -e, k) for k in OTHER_KINDS for s, e in (_names(text) if k == "name" else (m.span() for m in OTHER[k].finditer(text)))]
    taken = sorted(taken)
    starts = [s for s, _ in taken]
    upto = list(itertools.accumulate((e for _, e in taken), max))  # the last end of the spans so far
    out, last = [], 0
    for s, e, k in sorted(found):
        before = bisect.bisect_left(starts, -e)
        if s >= last and not (before and upto[before - 1] > s):
            out.append((k, s, -e))
            last = -e
    return out


def _check(kind: str, s: str) -> int:
    """What a kind's own rule says; 0 where it has none beside its pattern."""
    if kind == "account":
        s = s.replace(" ", "")
        return 1 if 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1 else -1
    if kind == "ssn":
        return -1 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else 1
    if kind == "birth":
        parts = [int(x) for x in re.split(r"[-./]", s)]
        y, rest = (parts[0], parts[1:]) if parts[0] > 31 else (parts[2], parts[:2])
        return 1 if 1900 <= y <= 2025 and all(1 <= x <= 31 for x in rest) and min(rest) <= 12 else -1
    if kind == "ip":
        return -1 if s.split(".")[0].lstrip("0") in ("", "10", "127", "255") else 1
    return 1 if kind == "card" else 0


def _listed(kind: str, s: str) -> bool | None:
    """Whether the gazetteer of a kind has the part of a span that it is about; None where there is no gazetteer."""
    if kind == "phone":
        code = re.sub(r"[^0-9]", "", s[:8])
        return code[:1] in CODES or code[:2] in CODES or code[:2] in ZONES
    if kind == "account":
        return s[:2] in COUNTRIES
    if kind == "name":
        return any(x in NAMES for x in s.split())
    if kind in ("email", "spelled"):
        return re.split(r"[.\x20()\[\]]+", s.rstrip(")]"))[-1].lower() in ENDINGS
    return None


def votes(text: str, kind: str, s: int, e: int) -> tuple[list[int], int]:
    """What the labelers say of a span, and its shape (length and share of digits, in steps)."""
    body = text[s:e]
    listed = _listed(kind, body)
    before = text[max(0, s - CONTEXT) : s]
    context = 1 if FOR.search(before) else -1 if AGAINST.search(before) else 0
    touched = (s and text[s - 1].isalnum()) or (e < len(text) and text[e].isalnum())
    digits = sum(c.isdigit() for c in body) / max(1, len(body))
    return [_check(kind, body), 0 if listed is None else 1 if listed else -1, context, -1 if touched else 1], 4 * min(3, (e - s) // 8) + min(3, int(4 * digits))


def scan(docs: DataFrame) -> DataFrame:
    """SPANS of each row: base counts, digest and spans, and all candidates with votes."""

    def of(text: str) -> tuple:
        base = base_spans(text)
        found = [(k, s, e, *votes(text, k, s, e)) for k in BASE_KINDS for s, e in base[k]]
        found += [(k, s, e, *votes(text, k, s, e)) for k, s, e in other_spans(text, [x for k in BASE_KINDS for x in base[k]])]
        spans = [f"{k}:{s}:{e}" for k in BASE_KINDS for s, e in base[k]]
        rows = [{"kind": k, "s": s, "e": e, "v": v, "shape": shape} for k, s, e, v, shape in found]
        return *(len(base[k]) for k in BASE_KINDS), hashlib.sha256(",".join(spans).encode()).hexdigest(), spans, rows

    kind = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32()), ("v", pa.list_(pa.int32())), ("shape", pa.int32())]))
    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.string()), kind]
    names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "base", "found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(zip(*(of(t.as_py() or "") for t in b.column(1)))) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SPANS)


def estimate(patterns: np.ndarray, counts: np.ndarray, *, rounds: int = 50, silent: bool = False) -> tuple[np.ndarray, float, np.ndarray]:
    """Expectation-maximisation over patterns of votes in {-1, 0, 1} and their counts.

    Returns each labeler's table P(vote | class) of shape (labelers, 2, 3), the share of class 1 and the
    posterior of each pattern. It starts from the sign of the votes' sum, so class 1 is what votes of 1 mean.
    With ``silent``, a vote of 0 is no evidence of either class; what a lone vote is worth then follows from the start,
    at which it counts ``SURE``.
    """
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    if silent:
        onehot[:, :, 1] = 0
    post = 1 / (1 + np.exp(-patterns.sum(axis=1) * (SURE if silent else 1.0)))
    table_ = np.full((patterns.shape[1], 2, 3), 1 / 3)
    for _ in range(rounds):
        for c, weight in ((1, post * counts), (0, (1 - post) * counts)):
            sums = np.einsum("p,plv->lv", weight, onehot)
            guess = np.array([[1.0, 1.0 - silent, 2.0]]) if c else np.array([[2.0, 1.0 - silent, 1.0]])  # a labeler is better than chance
            table_[:, c] = (sums + guess) / (sums + guess).sum(axis=1, keepdims=True)
        prior = ((post * counts).sum() + 1) / (counts.sum() + 2)
        logs = np.einsum("plv,lcv->pc", onehot, np.log(np.maximum(table_, 1e-300))) + np.log([1 - prior, prior])
        post = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
    return table_, prior, post


def _features(kind: str, v: list[int], shape: int) -> np.ndarray:
    kinds = BASE_KINDS + OTHER_KINDS
    x = np.zeros(1 + 2 * len(VOTES) + len(kinds) + 16)
    x[0] = 1
    for k, vote in enumerate(v):
        x[1 + 2 * k] = vote > 0
        x[2 + 2 * k] = vote < 0
    x[1 + 2 * len(VOTES) + kinds.index(kind)] = 1
    x[1 + 2 * len(VOTES) + len(kinds) + shape] = 1
    return x


def train(scanned: DataFrame) -> np.ndarray:
    """Weights of the span classifier; the driver sees one row for each pattern, at most 9 * 3**4 * 16."""
    rows = scanned.select(F.explode("found").alias("x")).groupBy("x.kind", "x.v", "x.shape").count().orderBy("kind", "v", "shape").collect()
    if not rows:
        return np.zeros(len(_features("name", [0] * len(VOTES), 0)))
    counts = np.array([r["count"] for r in rows], float)
    _, _, post = estimate(np.array([r["v"] for r in rows]), counts)
    x = np.stack([_features(r["kind"], r["v"], r["shape"]) for r in rows])
    w = np.zeros(x.shape[1])
    share = counts / counts.sum()
    for _ in range(500):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 2.0 * (x.T @ (share * (p - post)) + 1e-4 * w)
    return w


def decided(weights: np.ndarray) -> Column:
    """Spark condition on a candidate ``x``: the classifier takes it."""
    kinds = BASE_KINDS + OTHER_KINDS
    terms = [f"{float(weights[0])!r}D"]
    for k in range(len(VOTES)):
        terms.append(f"CASE x.v[{k}] WHEN 1 THEN {float(weights[1 + 2 * k])!r}D WHEN -1 THEN {float(weights[2 + 2 * k])!r}D ELSE 0D END")
    at = 1 + 2 * len(VOTES)
    terms.append("CASE x.kind " + " ".join(f"WHEN '{k}' THEN {float(weights[at + i])!r}D" for i, k in enumerate(kinds)) + " END")
    terms.append(f"array({', '.join(f'{float(x)!r}D' for x in weights[at + len(kinds) :])})[x.shape]")
    return F.expr(f"filter(found, x -> x.kind IN ({', '.join(repr(k) for k in OTHER_KINDS)}) AND {' + '.join(terms)} > 0D)")


def find(docs: DataFrame) -> DataFrame:
    """``doc_id``, base counts, ``base_sha256``, ``spans``, ``n_added`` and ``n_spans`` of each row."""
    scanned = table(scan(docs))
    added = scanned.withColumn("_more", decided(train(scanned)))
    rank = ", ".join(repr(k) for k in OTHER_KINDS)
    more = F.expr(f"transform(array_sort(transform(_more, x -> named_struct('k', array_position(array({rank}), x.kind), 's', x.s, 'e', x.e, 'kind', x.kind))), x -> concat(x.kind, ':', x.s, ':', x.e))")
    return added.select("doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", F.array_join(F.concat("base", more), ",").alias("spans"), F.size("_more").cast("long").alias("n_added"), (F.size("base") + F.size("_more")).cast("long").alias("n_spans"))
