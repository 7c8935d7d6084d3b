"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one scan: at-signs, plus signs,
digits, URL schemes and identifier cues. From each anchor a small
deterministic parser expands to the left and right, finds the boundaries and
validates (label structure, octet range, Luhn, digit counts, IBAN mod 97).

Kinds: email, ip, card, phone (the base), and url, iban, account.

* url: ``http://``, ``https://``, ``ftp://`` or ``www.`` in any ASCII case, then
  characters other than white space and ``<>"``, less closing punctuation;
  at least one character is left.
* iban: two capital letters, two digits and 11 to 30 capitals or digits in
  groups that single blanks may part, with ISO 7064 mod 97 remainder 1 and,
  where the country is registered, its length.
* account: a cue (account, acct, konto, cuenta, compte; any ASCII case) that no
  letter precedes, up to 12 characters of ``[ .:#]`` or ``number/no/nr``,
  then 6 to 20 digits that single blanks or hyphens may part.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import DataFrame

from coffer.llm.anchors import Span, masked, span_report

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account")

LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
LABEL = frozenset(string.ascii_letters + string.digits + "-")
DIGITS = frozenset(string.digits)
PHONE = frozenset(" ().-" + string.digits)
SCHEMES = ("http://", "https://", "ftp://", "www.")
CUES = ("account", "acct", "konto", "cuenta", "compte")
URL_STOPS = frozenset(' \t\n\r\x0b\x0c<>"')
CLOSING = ".,;:!?)]}'"
#: Characters of an IBAN by registered country; other countries' may have 15 to 34.
IBAN_LENGTHS = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 "
        "FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 "
        "LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 "
        "SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
_AFTER_CUE = re.compile(r"(?:[ .:#]|number|no|nr){0,12}([0-9](?:[ -]?[0-9])+)", re.IGNORECASE | re.ASCII)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _email(text: str, at: int, since: int) -> tuple[int, int] | None:
    """The address around the at-sign, not before ``since``."""
    s = at
    while s > since and text[s - 1] in LOCAL:
        s -= 1
    e, n, labels = at + 1, len(text), 0
    if s == at:
        return None
    while True:
        k = e + (labels > 0)
        if labels and (e >= n or text[e] != "."):
            break
        stop = k
        while stop < n and text[stop] in LABEL:
            stop += 1
        if stop == k:
            break
        e, labels = stop, labels + 1
    return (s, e) if labels > 1 else None


def _runs(text: str, at: int, joints: str) -> tuple[list[tuple[int, int]], int]:
    """Digit runs from ``at`` on that single characters of ``joints`` part, and where they end."""
    runs, n, e = [], len(text), at
    while True:
        s = e
        while e < n and text[e] in DIGITS:
            e += 1
        runs.append((s, e))
        if e + 1 < n and text[e] in joints and text[e + 1] in DIGITS:
            e += 1
        else:
            return runs, e


def _phone(text: str, plus: int) -> tuple[int, int] | None:
    n = len(text)
    if plus + 1 >= n or text[plus + 1] not in DIGITS:
        return None
    e = plus + 2
    while e < n and text[e] in PHONE:
        e += 1
    while e > plus + 2 and text[e - 1] not in DIGITS:
        e -= 1
    return (plus, e) if e >= plus + 4 else None


def _url(text: str, at: int, scheme: str) -> tuple[int, int] | None:
    e = at + len(scheme)
    while e < len(text) and text[e] not in URL_STOPS:
        e += 1
    while e > at + len(scheme) and text[e - 1] in CLOSING:
        e -= 1
    return (at, e) if e > at + len(scheme) else None


def _iban(text: str, digit: int) -> tuple[int, int] | None:
    """The first of the two check digits is the anchor."""
    s = digit - 2
    if s < 0 or not ("A" <= text[s] <= "Z" and "A" <= text[s + 1] <= "Z") or (s and text[s - 1].isalnum()):
        return None
    e, got, length = s, [], IBAN_LENGTHS.get(text[s:digit])
    while e < len(text) and len(got) < 35:
        c = text[e]
        if c in DIGITS or "A" <= c <= "Z":
            got.append(c)
        elif c != " " or not (e + 1 < len(text) and (text[e + 1] in DIGITS or "A" <= text[e + 1] <= "Z")):
            break
        e += 1
    while len(got) >= 15:  # a following word in capitals may have been taken in
        if got[2] in DIGITS and got[3] in DIGITS and len(got) <= 34 and length in (None, len(got)):
            value = int("".join(str(int(c, 36)) for c in got[4:] + got[:4]))
            if value % 97 == 1 and not (e < len(text) and text[e].isalnum()):
                return s, e
        e = text.rfind(" ", s, e)
        if e < 0:
            return None
        got = [c for c in text[s:e] if c != " "]
    return None


def _account(text: str, cue: int, word: str) -> tuple[int, int] | None:
    if cue and text[cue - 1].isalpha():
        return None
    m = _AFTER_CUE.match(text, cue + len(word))
    if m and 6 <= sum(c in DIGITS for c in m[1]) <= 20:
        return m.span(1)
    return None


class Finder:
    def __init__(self):
        import ahocorasick

        self.anchors = ahocorasick.Automaton()
        for c in "@+" + string.digits:
            self.anchors.add_word(c, c)
        for word in (*SCHEMES, *CUES):
            self.anchors.add_word(word, word)
        self.anchors.make_automaton()
        self.fold = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

    def __call__(self, text: str) -> list[Span]:
        out: list[Span] = []
        ends = dict.fromkeys(KINDS, 0)  # of the latest candidate, failing ones included

        def put(kind: str, span: tuple[int, int] | None) -> None:
            if span and span[0] >= ends[kind]:
                ends[kind] = span[1]
                out.append((kind, *span))

        digits = -1  # up to here digits belong to a run that has been looked at
        low = text.lower()
        if len(low) != len(text):  # some letter has no single lower-case one
            low = text.translate(self.fold)
        for last, word in self.anchors.iter(low):
            at = last + 1 - len(word)
            if word == "@":
                put("email", _email(text, at, ends["email"]))
            elif word == "+":
                if at >= ends["phone"] and (span := _phone(text, at)):
                    if 9 <= sum(c in DIGITS for c in text[slice(*span)]) <= 15:
                        put("phone", span)
                    ends["phone"] = span[1]
            elif word in DIGITS:
                if at <= digits:
                    continue
                run, digits = _runs(text, at, "")
                digits -= 1
                if at >= ends["ip"]:
                    self._ips(text, at, ends, out)
                if at >= ends["card"]:
                    runs, end = _runs(text, at, " -")
                    ends["card"] = end
                    number = "".join(text[s:e] for s, e in runs)
                    if 12 <= len(number) <= 19 and luhn(number):
                        out.append(("card", at, end))
                if at - 2 >= ends["iban"]:
                    put("iban", _iban(text, at))
            elif word in SCHEMES:
                if at >= ends["url"]:  # anchors inside a span are not looked at again
                    put("url", _url(text, at, word))
            else:
                put("account", _account(text, at, word))
        return out

    @staticmethod
    def _ips(text: str, at: int, ends: dict, out: list[Span]) -> None:
        """A chain of runs parted by dots, four by four."""
        runs, end = _runs(text, at, ".")
        for k in range(0, len(runs) - 3, 4):
            four = runs[k : k + 4]
            parts = [text[s:e].lstrip("0") for s, e in four]
            if all(len(x) <= 3 and int(x or "0") <= 255 for x in parts):
                out.append(("ip", four[0][0], four[3][1]))
        ends["ip"] = end


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_url, n_iban, n_account.

    One row per input row, repeated rows included. Offsets are code points. A
    null text counts as empty and has no spans. Other columns are ignored.
    """
    return span_report(docs, Finder, BASE, KINDS)


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs``, columns unchanged, with personal data replaced by ``<KIND>``; null texts stay null."""
    return masked(docs, Finder)
