"""Personal data in text: four fixed patterns and a semi-Markov conditional random field.

The field scores whole candidate segments by features of the segment as a unit (its shape, digits, check sums, the
words before it) and the change from the last entity's kind to its own. A segment of up to NEAR tokens may end
anywhere; a longer one, of any length, begins and ends with a run without white space, and what comes before its last
run has at most BEFORE code points, so that candidates are in proportion to the text and no value is cut. A
dynamic programme over segment ends and last kinds picks boundaries and kinds with the highest joint score.
It is trained once when the operator starts, by maximum likelihood, on sentences generated from the rules in
``training_sentences``. A run of letters and digits is one token, and so is a long run that also has ``-_+/=``.
An entity has a digit, an ``@``, a form of address or a word for a street,
so only the surroundings of these are decoded.

The patterns' spans always stay; a segment of the field is added where it overlaps none of them.

Edge cases: a null or empty text has no spans; offsets are code points; patterns take time in
proportion to the text, however long its runs of digits or local-part characters are. Each row is
handled by itself: repeated rows give repeated results, and other columns are not read.
"""

from __future__ import annotations

import heapq
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusspark.llm.common import table

#: Kinds in the order in which spans are listed; the first four have patterns.
KINDS = ["email", "ip", "card", "phone", "ssn", "iban", "secret", "person", "address"]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match that begins inside a run of digits would also begin at the run's start, so only starts are tried.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start."""
    out = []
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", max(floor, at + 1))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups()):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(digits_of(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


TITLES = frozenset("mr mrs ms miss dr prof herr frau mme mlle monsieur madame sr sra señor señora".split())
STREETS = frozenset("street avenue road lane boulevard drive square strasse straße allee platz gasse rue calle avenida plaza".split())
_WORDS = "|".join(sorted(f(w) for w in TITLES | STREETS for f in (str.capitalize, str.upper)))
#: A long run with a digit is one token; so is a run of letters and digits.
TOKEN = re.compile(r"(?=[A-Za-z_+/-]{0,200}[0-9])[A-Za-z0-9_+/-]{20,}={0,2}|[^\W_]+|\s+|.", re.S)
TRIGGER, NAMED = re.compile("[0-9@]"), re.compile(rf"(?:{_WORDS})(?![^\W_])")
#: Tokens of a segment that may end anywhere, and code points before the last run of a longer one.
NEAR, BEFORE = 14, 64
_OPENING, _CLOSING = frozenset("\"'([{<"), frozenset(".,;:!?=\"')]}>")
#: Code points around what may be an entity that are decoded with it.
AROUND = 48
#: An added segment must be better than no entity by this log score.
MARGIN = 1.0
CUES = {
    "mail": "email", "email": "email", "ip": "ip", "host": "ip", "server": "ip", "card": "card", "visa": "card", "credit": "card", "phone": "phone",
    "tel": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "ssn": "ssn", "social": "ssn", "security": "ssn", "iban": "iban", "account": "iban",
    "password": "secret", "passwd": "secret", "pwd": "secret", "secret": "secret", "token": "secret", "key": "secret", "apikey": "secret", "bearer": "secret",
}


class Features:
    """Numbers of features, fixed after training."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.open = True

    def of(self, names: list[str]) -> list[int]:
        if self.open:
            return [self.ids.setdefault(x, len(self.ids)) for x in names]
        return [self.ids[x] for x in names if x in self.ids]


def token_shape(t: str) -> str:
    """A token's kind: digits with their number, words by case, mixtures by length and whether they are hexadecimal."""
    if t.isdigit():
        return str(min(len(t), 20))
    if t[0].isspace():
        return "_"
    if not (t[0].isalnum() or len(t) > 1):
        return t
    if t.isalpha():
        return "A" if t.isupper() else "a" if t.islower() else "Aa" if t[0].isupper() else "aA"
    digits = sum(map(str.isdigit, t))
    kind = "x" if not t.lower().strip("0123456789abcdef") else "X" if t.isalnum() else "Z"
    size = "1" if len(t) < 8 else "8" if len(t) < 16 else "16" if len(t) < 32 else "32"
    if len(t) == 4 and t[:2].isalpha() and t[:2].isupper() and digits == 2:
        return "II"
    return kind + size + ("m" if 3 * digits < len(t) else "d")


class Text:
    """A stretch of text as tokens, with what is asked of each token again and again."""

    def __init__(self, text: str):
        self.tokens = TOKEN.findall(text)
        self.shapes = [token_shape(t) for t in self.tokens]
        self.low = [t.lower() for t in self.tokens]
        self.named = [t in TITLES or t in STREETS for t in self.low]
        live = [n or "@" in t or any(map(str.isdigit, t)) for n, t in zip(self.named, self.tokens, strict=True)]
        self.seen = [0]
        for x in live:
            self.seen.append(self.seen[-1] + x)
        self.cues, last, age = [], "none", 99
        for t in self.low:
            self.cues.append(last if age <= 5 else "none")
            age += 1
            if (kind := CUES.get(t)) is not None:
                last, age = kind, 0

    def _plain(self, k: int) -> bool:
        """A lower-case word that no entity goes across."""
        return self.shapes[k] == "a" and not self.named[k] and CUES.get(self.low[k]) != "secret"

    def _stops(self, s: int, e: int) -> bool:
        """Whether no segment from s goes over token e - 1: a new line, or a plain word after white space."""
        last = self.tokens[e - 1]
        return "\n" in last or last[0].isspace() and self._plain(s) or e - s > 1 and self._plain(e - 1) and self.tokens[e - 2][0].isspace()

    def _over(self, e: int) -> bool:
        """Whether nothing but closing signs comes before the next white space."""
        while e < len(self.tokens) and self.tokens[e] in _CLOSING:
            e += 1
        return e == len(self.tokens) or self.tokens[e][0].isspace() or self.tokens[e] == "&" and "=" in self.tokens[e + 1:e + 5]

    def _ends(self, s: int) -> Iterator[int]:
        """Where a segment from s may end."""
        n = len(self.tokens)
        for e in range(s + 1, min(n, s + NEAR) + 1):
            if self._stops(s, e):
                return
            yield e
        if s and not self.tokens[s - 1][0].isspace() and self.tokens[s - 1] not in _OPENING:
            return
        e, before = s + NEAR, sum(map(len, self.tokens[s:s + NEAR]))
        while e < n and before <= BEFORE:
            run = e  # from the end of a run, or within the one that the near segments reached
            while e < n and not self.tokens[e][0].isspace():
                if self._stops(s, e + 1):
                    return
                e += 1
            if e > run:
                tight = e
                while tight > s + NEAR and self.tokens[tight - 1] in _CLOSING:
                    tight -= 1
                yield from sorted({tight, e} - set(range(s + NEAR + 1)))
            before += sum(map(len, self.tokens[run:e]))
            while e < n and self.tokens[e][0].isspace():
                if self._stops(s, e + 1):
                    return
                before += len(self.tokens[e])
                e += 1

    def lattice(self, features: Features) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """Starts, ends and features of all segments that may be an entity."""
        starts, ends, rows, n = [], [], [], len(self.tokens)
        for s in range(n):
            first = self.tokens[s]
            if not (first[0].isalnum() or first in "+(" or len(first) > 1) or first[0].isspace() or s and self.shapes[s] == "a" and self._plain(s) and self.tokens[s - 1][-1].isalnum():
                continue
            for e in self._ends(s):
                if self.seen[e] > self.seen[s] and (names := self.features(s, e)):
                    starts.append(s)
                    ends.append(e)
                    rows.append(features.of(names))
        return np.array(starts, dtype=int), np.array(ends, dtype=int), rows

    def features(self, s: int, e: int) -> list[str] | None:
        """Features of tokens s to e as one segment; None if it can't be an entity."""
        own, shapes = self.tokens[s:e], self.shapes[s:e]
        if own[-1][0].isspace() or own[-1] in ".,;:!?=":
            return None
        text = "".join(own)
        before, after = self.tokens[s - 1] if s else " ", self.tokens[e] if e < len(self.tokens) else " "
        digits, letters = digits_of(text), sum(map(str.isalpha, text))
        groups = [t for t in own if t.isdigit()]
        side = lambda t: "w" if t[0].isalnum() else t[0]
        names = [
            "bias", f"cue:{self.cues[s]}", f"n:{len(own)}", f"digits:{min(len(digits), 24)}", f"letters:{min(letters, 12)}", f"first:{shapes[0]}", f"last:{shapes[-1]}",
            f"before:{side(before)}", f"after:{side(after)}", f"cue+shape:{self.cues[s]}:{shapes[0] if len(own) == 1 else len(groups)}",
        ]
        if len(own) <= 9:
            names.append("shape:" + "".join(shapes))
        if text.count("@") == 1:
            names.append("at")
            local, _, domain = text.partition("@")
            if local and re.fullmatch(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", domain) and not re.search(r"[^A-Za-z0-9._%+-]", local):
                names.append("mailbox")
        elif "@" in text:
            names.append("ats")
        if not letters:
            names.append("numeric")
            if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", text) and all(int(x) < 256 for x in groups):
                names.append("quad")
            if len(digits) >= 12 and re.fullmatch(r"[0-9](?:[ -]?[0-9])*", text):
                names.append("cardlike" + "-luhn" * luhn(digits))
            if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", text):
                names.append("ssnlike")
            if re.fullmatch(r"\+?[0-9(][0-9() .-]+", text) and 7 <= len(digits) <= 15 and len(groups) >= 2:
                names.append("dialled" + "+" * (text[0] == "+"))
        elif re.fullmatch(r"[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,4})?", text):
            names.append("ibanlike")
            more = e + 1 < len(self.tokens) and after == " " and re.fullmatch("[A-Z0-9]{1,4}", self.tokens[e + 1])
            names.append("iban-more" if more else "iban-end")
        if len(own) == 1 and letters and digits and len(text) >= 16:
            names.append("long-mix" + ("-hex" if shapes[0][0] == "x" else "-upper" if text.isupper() else ""))
        if re.match(r"(?:AKIA|ASIA|gh[a-z]_|sk-|xox[a-z]-|eyJ)[A-Za-z0-9_-]{12}", text):
            names.append("issued" + "-whole" * (len(own) == 1))
        keyed = re.fullmatch(r"""(?:[A-Za-z]+[_ -])?([A-Za-z]+)\s*[=:]\s*(["']?)([^\s=:,;"']{6,})(["']?)""", text)
        if keyed and CUES.get(keyed[1].lower()) == "secret":
            names.append("keyed" + ("" if keyed[2] == keyed[4] else "-half") + ("-whole" if side(before) != "w" and before not in "_-" and self._over(e) else "-part"))
            names.append("value:" + ("mixed" if re.search("[0-9]", keyed[3]) and re.search("[A-Za-z]", keyed[3]) else "plain"))
        elif "=" in text or ":" in text:
            names.append("other-key")
        if self.low[s] in TITLES and letters:
            words = sum(x in ("Aa", "A") for x in shapes[1:])
            following = self.shapes[e + 1] if e + 1 < len(self.tokens) and after.isspace() and "\n" not in after else ""
            names += ["titled", f"titled:{min(words, 4)}:{len(own) - 2 * words}", "titled-more" if following in ("Aa", "A") else "titled-end"]
        elif any(x in TITLES for x in self.low[s:e]):
            names.append("title-inside")
        if any(x in STREETS for x in self.low[s:e]):
            at = next(k for k in range(s, e) if self.low[k] in STREETS)
            odd = [x for x in shapes if x not in ("Aa", "A", "_", "1", "2", "3", "4", "x1d", "X1d", "a")]
            earlier = self.shapes[s - 2] if s > 1 and before.isspace() else ""
            names += [f"street:{'last' if at == e - 1 else 'first' if at == s else 'inside'}", f"street:{'named' if 'Aa' in shapes[:at - s] + shapes[at - s + 1:] else 'bare'}", "street-odd" if odd else "street-neat", f"street-case:{self.shapes[at]}"]
            names.append("street-more" if earlier == "Aa" or earlier.isdigit() else "street-whole")
            names.append("street-number" if groups else "street-only")
        if re.search(r"\s", text):
            names.append("spaced" + ("-letters" if re.search(r"[a-z]\s|\s[a-z]", text) else ""))
        return names


def training_sentences(n: int = 600, seed: int = 7) -> list[list[tuple[str, str]]]:
    """Sentences as (text, kind or '') parts, generated by rule."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))
    c = lambda: w().capitalize()
    mixed = lambda k, of: "".join(r.choice(of) for _ in range(k - 2)) + r.choice("abcdef") + d(1)
    hexa, both = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def card() -> str:
        body = d(15)
        full = next(body + str(k) for k in range(10) if luhn(body + str(k)))
        sep = r.choice(["", "", " ", "-"])
        return sep.join(full[k:k + 4] for k in range(0, 16, 4))

    def phone(cued: bool) -> str:
        a, b, x = d(3), d(3), d(4)
        forms = [f"+1 ({a}) {b}-{x}", f"({a}) {b}-{x}", f"{a}-{b}-{x}", f"+{r.randint(20, 99)} {d(2)} {d(4)} {d(4)}", f"+1-{a}-{b}-{x}", f"{a}.{b}.{x}"]
        return r.choice([*forms, f"{a} {b} {x}", f"{a} {b} {x}", f"0{d(2)} {d(3)} {d(4)}"]) if cued else r.choice(forms)

    def iban() -> str:
        t = r.choice(["DE", "FR", "ES", "GB", "IT"]) + d(2) + d(r.choice([16, 18, 20]))
        if r.random() < 0.4:  # letters, and up to 34 characters
            upper = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(k))
            t = upper(2) + d(2) + upper(4) + "".join(r.choice([d(1), d(1), d(1), upper(1)]) for _ in range(r.randint(8, 26)))
        return t if r.random() < 0.5 else " ".join(t[k:k + 4] for k in range(0, len(t), 4))

    def value() -> str:
        size = r.choice([8, 12, 16, 20, 24, 32, 40, 48, 64, 96, 128])
        signs = lambda: mixed(min(size, 40), both + "!#$%&*@^~?+-_.")
        return r.choice([lambda: mixed(size, hexa), lambda: mixed(size, hexa), lambda: mixed(size, both), lambda: mixed(size, both + "-_"), signs])()

    def keyed() -> str:
        key, quote = r.choice(["password", "passwd", "token", "api_key", "secret", "pwd", "key", "api-key", "Token", "PASSWORD"]), r.choice(["", "", '"', "'"])
        return key + r.choice(["=", ":", ": ", " = ", "="]) + quote + value() + quote

    def bare() -> str:
        return r.choice([
            lambda: r.choice(["AKIA", "ASIA"]) + "".join(r.choice(r.choice(["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"])) for _ in range(15)) + d(1), lambda: mixed(r.choice([32, 40, 64]), hexa),
            lambda: r.choice(["ghp_", "sk-", "xoxb-"]) + mixed(r.choice([24, 36, 48]), both), lambda: mixed(r.choice([32, 40, 48]), both),
        ])()

    make = {
        "email": lambda: f"{w()}{r.choice(['', '.', '_', '+'])}{r.choice([w(), d(2), ''])}x@{w()}.{r.choice(['com', 'example.com', 'org', 'co.uk'])}",
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), "card": card, "phone": lambda: phone(False), "iban": iban,
        "ssn": lambda: f"{d(3)}-{d(2)}-{d(4)}", "secret": lambda: keyed() if r.random() < 0.55 else bare(),
        "person": lambda: r.choice(["Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme"]) + r.choice([" ", " ", ". "]) + " ".join(c() for _ in range(r.choice([1, 2, 2, 3]))),
        "address": lambda: r.choice([
            lambda: f"{d(r.randint(1, 3))} {c()} {r.choice(['Street', 'Avenue', 'Road', 'Lane', 'Drive'])}", lambda: f"{c()} {r.choice(['Street', 'Avenue', 'Road', 'Square'])}",
            lambda: f"{d(2)} {c()} {c()} {r.choice(['Street', 'Road'])}", lambda: f"{r.choice(['Rue', 'Calle', 'Plaza'])} {c()} {d(2)}",
        ])(),
    }
    clean = [
        lambda: d(r.randint(1, 6)), lambda: f"{r.randint(1, 99)}.{r.randint(0, 99)}", lambda: f"{r.randint(1900, 2099)}-{d(2)}-{d(2)}", lambda: f"{d(1)},{d(3)},{d(3)}",
        lambda: f"{d(2)}:{d(2)}", lambda: f"{d(2)}%", lambda: f"${d(3)}.{d(2)}", lambda: f"{w()}{d(2)}", lambda: f"v{d(1)}.{d(1)}.{d(1)}", lambda: f"{r.randint(1, 20)} {w()} {d(2)}",
        lambda: f"@{w()}", lambda: f"page={d(2)}", lambda: d(12), lambda: f"{d(4)}-{d(4)}", lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: d(3) + " " + d(3) + " " + d(3), lambda: d(r.randint(7, 20)), lambda: f"({r.randint(1900, 2030)})",
        lambda: f"the {r.choice(['street', 'road', 'square', 'drive', 'rue'])} {w()}", lambda: f"{r.choice(['dr', 'ms', 'sr'])} {w()}", lambda: f"{c()} {c()} {w()}", lambda: f"{c()} {d(1)}", lambda: f"key: {w()}", lambda: f"token {w()} {d(2)}",
        lambda: f"{w()}_{w()}_{d(2)}", lambda: f"{w()}-{w()}-{w()}-{w()}", lambda: f"ISBN {d(3)}-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"{d(3)} {w()} {d(3)}", lambda: f"key={d(1)}", lambda: f"{c()}. {d(2)} {w()}",
    ]
    cue = {"ssn": ["SSN", "social security"], "iban": ["IBAN", "account"], "phone": ["phone", "call", "tel"], "card": ["card", "visa"], "email": ["email"], "ip": ["host", "ip"]}
    out = []
    for _ in range(n):
        parts: list[tuple[str, str]] = [(w() + " ", "")]
        for _ in range(r.randint(1, 3)):
            parts.append((" ".join(w() for _ in range(r.randint(1, 4))) + " ", ""))
            if r.random() < 0.55:
                kind = r.choice([*make, "secret"])
                cued = kind in cue and r.random() < 0.5
                if kind == "secret" and r.random() < 0.4:
                    own = bare()
                    parts += [(r.choice(["", "key ", "secret key ", "token "]), ""), (own, kind), (r.choice([" ", "", " key ", ", "]), "")]
                    continue
                if cued:
                    parts.append((r.choice(cue[kind]) + r.choice([" ", ": "]), ""))
                parts.append((phone(cued) if kind == "phone" else make[kind](), kind))
            else:
                parts.append((r.choice(clean)(), ""))
            parts.append((r.choice([" ", ", ", ". ", " ", "\n", " | ", "; "]), ""))
        parts.append((w() + ".", ""))
        out.append(parts)
    return out


def _gathered(values: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return np.logaddexp.reduceat(values, heads, axis=0)


class Batch:
    """Lattices of several texts side by side: segments with text, start, end and features; gold kinds."""

    def __init__(self, data: list[tuple[int, np.ndarray, np.ndarray, list[list[int]], dict]], n_features: int):
        self.n_features, self.lengths = n_features, np.array([x[0] for x in data])
        self.text = np.concatenate([np.full(len(x[1]), k) for k, x in enumerate(data)])
        self.start, self.end = (np.concatenate([x[j] for x in data]) for j in (1, 2))
        rows = [row for x in data for row in x[3]]
        self.flat, self.row = np.concatenate([np.array(r) for r in rows]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.gold = np.full(len(rows), -1)
        self.moves = np.zeros((len(KINDS) + 1, len(KINDS)))
        at = 0
        for _, starts, ends, _, gold in data:
            last = len(KINDS)
            for k in sorted(range(len(starts)), key=lambda k: ends[k]):  # gold segments don't overlap
                if (kind := gold.get((int(starts[k]), int(ends[k])))) is not None:
                    self.gold[at + k] = kind
                    self.moves[last, kind] += 1
                    last = kind
            at += len(starts)
        # By end and by start, with where each text's run of segments begins.
        self.by_end = self._runs(self.end, np.lexsort((self.text, self.end)))
        self.by_start = self._runs(self.start, np.lexsort((self.text, self.start)))

    def _runs(self, key: np.ndarray, order: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        out = {}
        for k in np.unique(key):
            own = order[key[order] == k]
            heads = np.flatnonzero(np.concatenate(([True], self.text[own[1:]] != self.text[own[:-1]])))
            out[int(k)] = (own, heads)
        return out

    def gradient(self, weights: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the log likelihood, by forward and backward sums over positions and last kinds."""
        n, kinds, most = len(self.lengths), len(KINDS), int(self.lengths.max())
        score = np.stack([np.bincount(self.row, weights[self.flat, k], len(self.gold)) for k in range(kinds)], axis=1)
        alpha, beta = (np.full((most + 1, n, kinds + 1), -np.inf) for _ in range(2))
        alpha[0, :, kinds] = 0
        came = np.full((len(self.gold), kinds), -np.inf)
        for e in range(1, most + 1):
            alpha[e] = alpha[e - 1]
            if e in self.by_end:
                own, heads = self.by_end[e]
                came[own] = np.logaddexp.reduce(alpha[self.start[own], self.text[own]][:, :, None] + moves[None], axis=1) + score[own]
                texts = self.text[own[heads]]
                alpha[e, texts, :kinds] = np.logaddexp(alpha[e, texts, :kinds], _gathered(came[own], heads))
        beta[self.lengths, np.arange(n)] = 0
        for s in range(most - 1, -1, -1):
            inside = s < self.lengths
            beta[s, inside] = beta[s + 1, inside]
            if s in self.by_start:
                own, heads = self.by_start[s]
                goes = np.logaddexp.reduce(moves[None] + (score[own] + beta[self.end[own], self.text[own]][:, :kinds])[:, None, :], axis=2)
                texts = self.text[own[heads]]
                beta[s, texts] = np.logaddexp(beta[s, texts], _gathered(goes, heads))
        total = beta[0, :, kinds][self.text]
        ahead = beta[self.end, self.text][:, :kinds]
        marginal = np.exp(came + ahead - total[:, None])
        pairs = np.exp(alpha[self.start, self.text][:, :, None] + moves[None] + (score + ahead - total[:, None])[:, None, :])
        off = -marginal
        some = np.flatnonzero(self.gold >= 0)
        off[some, self.gold[some]] += 1
        return np.stack([np.bincount(self.flat, off[self.row, k], self.n_features) for k in range(kinds)], axis=1), self.moves - pairs.sum(axis=0)


class Field:
    """The trained field: a weight for each feature and kind, and for each change of kind; the last row of moves is
    for the first entity. Tokens outside entities have score 0 and keep the last kind."""

    def __init__(self, features: Features, weights: np.ndarray, moves: np.ndarray):
        self.features, self.weights, self.moves = features, weights, moves

    def segments(self, text: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of tokens; starts, ends and scores by kind of segments; where tokens begin, with the end."""
        parsed = Text(text)
        starts, ends, rows = parsed.lattice(self.features)
        scores = np.array([self.weights[x].sum(axis=0) for x in rows]).reshape(len(rows), len(KINDS)) - MARGIN
        return len(parsed.tokens), starts, ends, scores, np.concatenate(([0], np.cumsum([len(t) for t in parsed.tokens])))

    def decode(self, text: str) -> list[tuple[str, int, int]]:
        """The best joint choice of segments and kinds."""
        n, starts, ends, scores, at = self.segments(text)
        fine = np.flatnonzero(scores.max(axis=1, initial=-np.inf) + self.moves.max() > 0) if len(starts) else []
        if not len(fine):
            return []
        by_end: dict[int, list[int]] = {}
        for k in fine:
            by_end.setdefault(int(ends[k]), []).append(int(k))
        none = len(KINDS)
        best, back = np.full((n + 1, none + 1), -np.inf), {}
        best[0, none] = 0
        for e in range(1, n + 1):
            best[e] = best[e - 1]
            for k in by_end.get(e, ()):
                into = best[starts[k]][:, None] + self.moves
                last = into.argmax(axis=0)
                gain = into[last, np.arange(none)] + scores[k]
                for kind in np.flatnonzero(gain > best[e, :none]):
                    best[e, kind] = gain[kind]
                    back[e, int(kind)] = (k, int(last[kind]))
        out, e, kind = [], n, int(best[n].argmax())
        while e:
            if (e, kind) in back and (e == 0 or best[e, kind] != best[e - 1, kind]):
                k, last = back[e, kind]
                out.append((KINDS[kind], int(at[starts[k]]), int(at[e])))
                e, kind = int(starts[k]), last
            else:
                e -= 1
        return out[::-1]


def train(epochs: int = 30, parts: int = 6, rate: float = 0.4, l2: float = 0.0003) -> Field:
    """Maximum likelihood by AdaGrad over parts of the sentences."""
    features, data = Features(), []
    for sentence in training_sentences():
        text = Text("".join(t for t, _ in sentence))
        at = {int(p): k for k, p in enumerate(np.concatenate(([0], np.cumsum([len(t) for t in text.tokens]))))}
        starts, ends, rows = text.lattice(features)
        gold, pos = {}, 0
        for t, kind in sentence:
            if kind:
                gold[at.get(pos), at.get(pos + len(t))] = KINDS.index(kind)
            pos += len(t)
        if len(starts):
            data.append((len(text.tokens), starts, ends, rows, gold))
    features.open = False
    n = len(features.ids)
    batches = [Batch(data[k::parts], n) for k in range(parts)]
    weights, moves = np.zeros((n, len(KINDS))), np.zeros((len(KINDS) + 1, len(KINDS)))
    squares = [np.full(x.shape, 1e-8) for x in (weights, moves)]
    for _ in range(epochs):
        for batch in batches:
            for x, g, q in zip((weights, moves), batch.gradient(weights, moves), squares, strict=True):
                g = g - l2 * len(batch.lengths) * x
                q += g**2
                x += rate * g / np.sqrt(q)
    return Field(features, weights, moves)


def windows(text: str) -> Iterator[tuple[int, int]]:
    """The stretches of text that may hold an entity, cut at white space."""
    start = end = -1
    named = (m for m in NAMED.finditer(text) if not m.start() or not text[m.start() - 1].isalnum())
    for m in heapq.merge(TRIGGER.finditer(text), named, key=re.Match.start):
        if start >= 0 and m.start() - end <= 2 * AROUND:
            end = m.end()
            continue
        if start >= 0:
            yield _widen(text, start, end)
        start, end = m.start(), m.end()
    if start >= 0:
        yield _widen(text, start, end)


def _widen(text: str, start: int, end: int) -> tuple[int, int]:
    """Some characters further each way, and on to the end of a word, however long."""
    a, b = max(0, start - AROUND), min(len(text), end + AROUND)
    while a > 0 and not text[a - 1].isspace():
        a -= 1
    while b < len(text) and not text[b].isspace():
        b += 1
    return a, b


def find_spans(text: str, field: Field) -> tuple[list[tuple], list[tuple]]:
    """The patterns' spans, and all spans, each by kind and start."""
    base = pattern_spans(text)
    # Stretches that the patterns' spans cover, which may overlap each other.
    begins, stops = [], []
    for s, e in sorted((s, e) for _, s, e in base):
        if stops and s < stops[-1]:
            stops[-1] = max(stops[-1], e)
        else:
            begins.append(s)
            stops.append(e)
    extra, reach = [], 0
    for a, b in windows(text):
        a = max(a, reach)
        for kind, s, e in field.decode(text[a:b]):
            k = bisect_left(begins, e + a) - 1
            if k < 0 or stops[k] <= s + a:
                extra.append((kind, s + a, e + a))
        reach = max(reach, b)
    return base, sorted(base + extra, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and spans: arrays of kind, start, end for every row."""
    field = train()
    weights, moves, ids = field.weights, field.moves, field.features.ids
    kind = "array<struct<kind:string,start:int,end:int>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        features.ids, features.open = ids, False
        own = Field(features, weights, moves)
        for pdf in batches:
            found = [find_spans(t, own) if t else ([], []) for t in pdf["text"]]
            as_rows = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "base": [as_rows(b) for b, _ in found], "spans": [as_rows(s) for _, s in found]})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"doc_id long, base {kind}, spans {kind}")


def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
