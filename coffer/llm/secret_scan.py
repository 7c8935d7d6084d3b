"""Secret scans by token efficiency.

Natural words take few tokens of a byte-pair vocabulary, random strings take
many: a candidate run whose characters per token fall below a threshold is
reported, unless it is a known kind of digest or identifier (UUID, hex digest
of a standard length, plain number, dotted or dashed date and version). Where
a run as a whole passes, its stretches of parts between ``/``, ``-``, ``_`` and
``+`` are judged, so that words around a key do not hide it. Three base
patterns (assignments, access keys, long hex) are always reported.

Kinds: assign, access, hex (the base), and random.
"""

from __future__ import annotations

import base64
import re

from pyspark.sql import DataFrame

from coffer.llm.anchors import Span, masked, span_report

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")

_ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A cue in lower case that an assignment contains.
_CUES = ("passw", "secret", "token", "api")

#: Candidates: runs of characters that keys consist of.
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_KNOWN = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # UUID
    re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.I),  # digests
    re.compile(r"[0-9]+([-_/=+][0-9]+)*"),  # numbers, dates
)
_PART = re.compile(r"[A-Za-z0-9]+")
#: Identifiers between joints inside a run.
_INSIDE = re.compile(r"(?<![A-Za-z0-9])(?:%s|%s)(?![A-Za-z0-9])" % (_KNOWN[0].pattern, _KNOWN[1].pattern.replace("0-9a-f", "0-9a-fA-F")))
MIN_CHARS = 16
#: Characters per token at most; ordinary long words have more.
MAX_RATIO = 1.9
#: Runs of joints alone are line art.
_RULE = re.compile(r"[+/_=-]*")


class Finder:
    def __init__(self, ranks_file: str, pattern: str, max_ratio: float = MAX_RATIO):
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.max_ratio = max_ratio

    def is_random(self, run: str) -> bool:
        if len(run) < MIN_CHARS or _RULE.fullmatch(run) or any(k.fullmatch(run) for k in _KNOWN):
            return False
        return len(run) <= self.max_ratio * len(self.tokens(run))

    def _stretches(self, run: str) -> list[list[tuple[int, int]]]:
        """The parts of each stretch of parts that has more tokens than its characters allow.

        These are the maximal scoring subsequences (Ruzzo and Tompa) of the parts'
        surpluses of tokens; identifiers end a stretch."""
        out = []
        known = [m.span() for m in _INSIDE.finditer(run)]
        for s, e in zip([0, *(k[1] for k in known)], [*(k[0] for k in known), len(run)], strict=True):
            # sum before, sum with, first and last part, nearest stretch before that starts from a lower sum
            found: list[tuple[float, float, int, int, int]] = []
            parts = [m.span() for m in _PART.finditer(run, s, e)]
            total = 0.0
            for i, (a, b) in enumerate(parts):
                # a part at the very limit counts as above it
                gain = self.max_ratio * len(self.tokens(run[a:b])) - (b - a) + 1e-9
                before, total = total, total + gain
                if gain <= 0:
                    continue
                low, high, first = before, total, i
                while True:
                    j = len(found) - 1
                    while j >= 0 and found[j][0] >= low:
                        j = found[j][4]
                    if j < 0 or found[j][1] >= high:
                        break
                    low, _, first, _, _ = found[j]
                    del found[j:]
                found.append((low, high, first, i, j))
            out += [parts[f : last + 1] for _, _, f, last, _ in found]
        return out

    def random_spans(self, run: str) -> list[tuple[int, int]]:
        """The whole run if it is random, else its random stretches, else their random parts."""
        if self.is_random(run):
            return [(0, len(run))]
        if len(run) <= MIN_CHARS or any(k.fullmatch(run) for k in _KNOWN):
            return []
        out = []
        for parts in self._stretches(run):
            s, e = parts[0][0], parts[-1][1]
            if e - s < MIN_CHARS:
                continue
            if self.is_random(run[s:e]):
                out.append((s, e))
            else:
                out += [(a, b) for a, b in parts if self.is_random(run[a:b])]
        return out

    def __call__(self, text: str) -> list[Span]:
        out: list[Span] = []
        low = text.lower()
        if any(c in low for c in _CUES):
            out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
        out += [("hex", *m.span()) for m in _HEX.finditer(text)]
        out += [("random", m.start() + s, m.start() + e) for m in _RUN.finditer(text) for s, e in self.random_spans(m[0])]
        return out


def _finder(ranks_file: str, pattern: str, max_ratio: float):
    def make():
        return Finder(ranks_file, pattern, max_ratio)

    return make


def find_secrets(docs: DataFrame, ranks_file: str, pattern: str, max_ratio: float = MAX_RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    One row per input row, repeated rows included. Offsets are code points. A
    null text counts as empty and has no spans. Other columns are ignored.
    ``ranks_file`` is a tiktoken vocabulary that every executor can open.
    """
    return span_report(docs, _finder(ranks_file, pattern, max_ratio), BASE, KINDS)


def mask_secrets(docs: DataFrame, ranks_file: str, pattern: str, max_ratio: float = MAX_RATIO) -> DataFrame:
    """``docs``, columns unchanged, with secrets replaced by ``<KIND>``; null texts stay null."""
    return masked(docs, _finder(ranks_file, pattern, max_ratio))
