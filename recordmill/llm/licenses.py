"""License scans: template markup compiled into token automata.

A template is text with two marks: ``[[ ... ]]`` is optional (marks nest), ``{{n}}`` stands for one to n
words of any kind. All other words are mandatory and must match exactly, in order and side by side. A
template becomes a small non-deterministic automaton over words; a text is accepted where a run of the
automaton ends. Runs begin only where a word stands that can begin the template.

Words are runs of lower-cased characters other than ASCII punctuation and blanks. Beside the templates,
the base phrases are looked up word by word; their labels stay whatever the templates say.

Defined results: a null text counts as empty; a text without a match has empty labels and null places;
repeated rows each get their row; extra columns are ignored. ``n_templates`` counts the templates that are
accepted somewhere in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm.license_texts import TEMPLATES

# The base phrases and their labels.
BASE = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}

COLUMNS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_templates long"
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TO_WORDS).split()


class Automaton:
    """A template as states with edges (word or None for any word) and empty moves; state 0 begins."""

    def __init__(self, template: str) -> None:
        self.edges: list[list[tuple[bytes | None, int]]] = [[]]
        self.skips: list[list[int]] = [[]]
        marks = re.findall(r"\[\[|\]\]|\||\{\{\d+\}\}|[^\s\[\]|{}]+", template)
        self.end, rest = self._sequence(marks, 0, 0)
        if rest != len(marks):
            raise ValueError(f"marks don't match in template {template!r}")
        self.closed = [self._closure(s) for s in range(len(self.edges))]
        if any(w is None for s in self.closed[0] for w, _ in self.edges[s]) or self.end in self.closed[0]:
            raise ValueError(f"template {template!r} can begin with any word, or match none")
        #: The words that can begin a match, each with those that can follow; None where any word, or none, can.
        self.starts: dict[bytes, set[bytes] | None] = {}
        for w, to in ((w, to) for s in self.closed[0] for w, to in self.edges[s]):
            after = {x for s in self.closed[to] for x, _ in self.edges[s]}
            free = None in after or self.end in self.closed[to] or self.starts.get(w, after) is None
            self.starts[w] = None if free else after | (self.starts.get(w) or set())

    def _state(self) -> int:
        self.edges.append([])
        self.skips.append([])
        return len(self.edges) - 1

    def _sequence(self, marks: list[str], k: int, state: int) -> tuple[int, int]:
        while k < len(marks) and marks[k] not in ("]]", "|"):
            mark, k = marks[k], k + 1
            if mark == "[[":
                out = self._state()
                self.skips[state].append(out)
                while True:
                    inner = self._state()
                    self.skips[state].append(inner)
                    last, k = self._sequence(marks, k, inner)
                    self.skips[last].append(out)
                    if k >= len(marks):
                        raise ValueError("an optional region isn't closed")
                    k += 1
                    if marks[k - 1] == "]]":
                        break
                state = out
            elif mark.startswith("{{"):
                out = self._state()
                for _ in range(max(1, int(mark[2:-2]))):
                    after = self._state()
                    self.edges[state].append((None, after))
                    self.skips[after].append(out)
                    state = after
                state = out
            else:
                for w in words(mark):
                    after = self._state()
                    self.edges[state].append((w, after))
                    state = after
        return state, k

    def _closure(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def match(self, text: list[bytes], at: int) -> int | None:
        """The end of the longest match that begins at ``at``, or None."""
        now, end = self.closed[0], None
        while True:
            if self.end in now:
                end = at
            if at == len(text):
                return end
            word, after = text[at], set()
            for s in now:
                for w, to in self.edges[s]:
                    if w is None or w == word:
                        after |= self.closed[to]
            if not after:
                return end
            now, at = after, at + 1


def _base(text: list[bytes]) -> list[tuple[int, str]]:
    found = []
    for phrase, label in BASE.items():
        want = [w.encode() for w in phrase]
        at = -1
        while True:
            try:
                at = text.index(want[-1], at + 1)
            except ValueError:
                break
            if at >= len(want) - 1 and text[at - len(want) + 1 : at + 1] == want:
                found.append((at - len(want) + 1, label))
    return found


def scan_text(text: str | None, machines: dict[str, Automaton]) -> tuple:
    """The columns after doc_id for one text."""
    w = words(text)
    base = _base(w)
    found: set[str] = set()
    starts: dict[bytes, list[str]] = {}
    for name, m in machines.items():
        for word in m.starts:
            starts.setdefault(word, []).append(name)
    for word, names in starts.items():
        at = -1
        while open_ := [x for x in names if x not in found]:
            try:
                at = w.index(word, at + 1)
            except ValueError:
                break
            after = w[at + 1] if at + 1 < len(w) else None
            for name in open_:
                second = machines[name].starts[word]
                if (second is None or after in second) and machines[name].match(w, at) is not None:
                    found.add(name)
    labels, n = {x for _, x in base} | found, len(found)
    places = [p for p, _ in base]
    score = 1.0 if n else 0.5 if base else 0.0
    return len(w), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score, n


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """COLUMNS of each row of ``docs(doc_id, text)``; ``score`` is 1 if a template is accepted, 0.5 for a base phrase alone."""
    templates = dict(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = {name: Automaton(t) for name, t in templates.items()}
        kinds = [(x.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]]) for x in COLUMNS.split(", ")]
        for b in batches:
            rows = [scan_text(t.as_py(), machines) for t in b.column(1)]
            columns = list(zip(*rows)) or [()] * (len(kinds) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, (_, k) in zip(columns, kinds[1:]))], [n for n, _ in kinds])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, COLUMNS)


def sql() -> str:
    """DuckDB SQL for ``scan``: its regular expressions say over joined words what the automata say over words."""

    def pattern(template: str) -> str:
        marked = template.replace("|", " | ").replace("[[", " [[ ").replace("]]", " ]] ").split()
        out = []
        for m in marked:
            n = re.fullmatch(r"\{\{(\d+)\}\}", m)
            out.append({"[[": "(?:", "]]": ")?", "|": "|"}.get(m) or (f"(?: [^ ]+){{1,{n[1]}}}" if n else "".join(f" {x.decode()}" for x in words(m))))
        return "".join(out) + " "

    places = " || ".join(
        f"list_transform(list_filter(ks, lambda i: {' AND '.join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase))}), lambda i: {{'i': i - 1, 'l': '{label}'}})"
        for phrase, label in BASE.items()
    )
    found = ", ".join(f"CASE WHEN regexp_matches(t, '{pattern(t)}') THEN '{name}' END" for name, t in sorted(TEMPLATES.items()))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
        WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        joined AS (SELECT doc_id, w, range(1, len(w) + 1) AS ks, ' ' || array_to_string(w, ' ') || ' ' AS t FROM words),
        hits AS (SELECT doc_id, len(w) AS n, {places} AS p, list_filter([{found}], lambda x: x IS NOT NULL) AS f FROM joined)
        SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, CAST(list_min(list_transform(p, lambda x: x.i)) AS BIGINT) AS first_word,
            CAST(list_max(list_transform(p, lambda x: x.i)) AS BIGINT) AS last_word, array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.l))), ',') AS base_labels,
            array_to_string(list_sort(list_distinct(list_concat(list_transform(p, lambda x: x.l), f))), ',') AS labels,
            CASE WHEN len(f) > 0 THEN 1.0::DOUBLE WHEN len(p) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score, CAST(len(f) AS BIGINT) AS n_templates
        FROM hits"""
