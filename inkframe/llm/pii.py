"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss."""

from __future__ import annotations

import bisect
import math
import random
import re
from collections.abc import Iterator
from functools import cache
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds in the order in which spans are listed. The patterns find the first four.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4
#: Fixed patterns; the possessive repeats match the same spans in linear time.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the four patterns, leftmost and non-overlapping within a kind; failing matches are dropped."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            done = m.end()
            out.append((0, start, done))
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


DIGIT = re.compile(r"[0-9]")
#: Tokens of a window: words, numbers and single signs; blanks are not tokens.
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
#: What makes the model look at a place: no entity is without a digit or @.
TRIGGER, SURE = re.compile(r"[0-9@][^\s]*"), re.compile(r"[0-9@]")
#: Tokens that an entity has at most; the other label, 0, is one token outside any entity. Tokens on each side
#: of a trigger that an entity with it and the features of that entity can reach, and one that may be cut.
LONGEST, REACH = 12, 15
#: Tokens after which decoding passes on what is settled; features whose weights a process remembers.
FLUSH, REMEMBERED = 4096, 200_000


def _plain(token: str) -> str:
    return token.lower() if token.isalpha() else ("9" * min(len(token), 5) if token.isdigit() else ("x9" if token.isalnum() else token))


class Token:
    """What the features of spans need of one token."""

    __slots__ = ("start", "end", "plain", "shape", "digits", "letters", "sure", "ends", "opens", "known")

    def __init__(self, start: int, end: int, body: str):
        self.start, self.end, self.plain = start, end, _plain(body)
        self.digits, self.letters = sum(c.isdigit() for c in body), sum(c.isalpha() for c in body)
        shape = re.sub(r"a+", "a", re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", body)))
        self.shape = re.sub(r"9{5,}", "9N", shape)
        self.sure, self.ends = SURE.search(body) is not None, body[0].isalnum()
        self.opens = self.ends or body in "+("
        self.known: tuple[str, ...] | None = None  # features of the token as an entity of one word of letters and digits
        if self.digits and self.letters and body.isascii() and self.ends:
            self.known = ("mixed",) if self.digits >= 2 and self.letters >= 3 else ()
            if self.known and len(body) >= 20:
                self.known += (f"hex={bool(re.fullmatch('[0-9a-fA-F]+', body))}",)
            if len(body) >= 16:
                self.known += (f"key={min(len(body), 40) // 8}{'U' if body.isupper() else 'l' if body.islower() else 'M'}",)


def tokens_of(text: str, lo: int = 0, hi: int | None = None) -> Iterator[Token]:
    for m in TOKEN.finditer(text, lo, len(text) if hi is None else hi):
        yield Token(*m.span(), m[0])


def body_features(shape: str, digits: int, letters: int, n: int, at: bool, blank: bool, luhns: bool | None, octets: bool | None, known: tuple[str, ...]) -> list[str]:
    """Features of a whole span: its form, whatever surrounds it."""
    out = ["shape=" + ("mixed" if "mixed" in known else shape), f"digits={digits}", f"letters={letters}", f"tokens={n}", *(x for x in known if x != "mixed")]
    out += ["at"] * at + ["blank"] * blank
    if luhns is not None:
        out.append(f"luhn={luhns}")
    if octets is not None:
        out.append(f"octets={octets}")
    return out


OCTETS = re.compile(r"9{1,3}(?:\.9{1,3}){3}")


def bodies(text: str, tokens: list[Token], j: int, least: int = 0) -> Iterator[tuple[int, tuple]]:
    """(i, arguments of ``body_features``) of each candidate entity of the tokens i to j - 1, the shortest first.

    Candidates have up to LONGEST tokens of one line, a digit or @ somewhere, and start and end with words, numbers, + or (.
    """
    last = tokens[j - 1]
    if not last.ends:
        return
    shape, digits, letters, sure, at, blank = "", 0, 0, False, False, False
    for i in range(j - 1, max(least, j - LONGEST) - 1, -1):
        t = tokens[i]
        if i < j - 1 and t.end < tokens[i + 1].start:
            gap = text[t.end : tokens[i + 1].start]
            if "\n" in gap:
                return
            blank = blank or " " in gap
            shape = gap + shape
        shape = t.shape + shape
        digits, letters, sure, at = digits + t.digits, letters + t.letters, sure or t.sure, at or t.plain == "@"
        if sure and t.opens:
            luhns = luhn(re.sub("[^0-9]", "", text[t.start : last.end])) if 13 <= digits <= 19 and not letters else None
            octets = all(int(p) < 256 for p in text[t.start : last.end].split(".")) if j - i == 7 and OCTETS.fullmatch(shape) else None
            yield i, (shape[:32], min(digits, 20), min(letters, 6), j - i, at, blank, luhns, octets, t.known or () if i == j - 1 else ())


def _number(t: Token | None) -> str:
    return "^" if t is None else "9" if t.plain[0] == "9" else "a"


def context_features(tokens: list[Token], i: int, j: int) -> list[str]:
    """Features of what surrounds the tokens i to j - 1."""
    return [
        "sides=" + _number(tokens[i - 1] if i else None) + _number(tokens[j] if j < len(tokens) else None),
        "before=" + (tokens[i - 1].plain if i else "^"), "after=" + (tokens[j].plain if j < len(tokens) else "$"), "before2=" + (tokens[i - 2].plain if i > 1 else "^"),
        "glued=" + str(i > 0 and tokens[i - 1].end == tokens[i].start) + str(j < len(tokens) and tokens[j - 1].end == tokens[j].start),
    ]


class Weights(dict):
    """The weight of each (feature, kind); for decoding, the sums over a span's features by kind, each list with its largest."""

    def __init__(self, *given):
        super().__init__(*given)
        self.known: dict = {}

    def of(self, key, features=None) -> tuple[float, ...]:
        """The sums over ``features(*key)``, or the weights of the one feature ``key``."""
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            names = [key] if features is None else [*features(*key), "bias"]
            sums = [sum(self.get((x, k), 0.0) for x in names) for k in range(len(KINDS))]
            found = self.known[key] = (max(sums), *sums)
        return found


def _lattice(text: str, tokens: list[Token], w: dict) -> list[list[tuple[int, int, float, list[str] | None]]]:
    """For each end position: (start, kind + 1 or 0, score, features) of the segments that end there."""
    by_end: list[list] = [[]]
    for j in range(1, len(tokens) + 1):
        by_end.append([(j - 1, 0, 0.0, None)])
        for i, form in bodies(text, tokens, j):
            found = [*body_features(*form), *context_features(tokens, i, j), "bias"]
            by_end[j] += [(i, kind + 1, sum(w.get((x, kind), 0.0) for x in found), found) for kind in range(len(KINDS))]
    return by_end


def decode(text: str, w: Weights, lo: int = 0, hi: int | None = None) -> list[Span]:
    """The best segmentation of ``text[lo:hi]``: boundaries and kinds together, by dynamic programming over ends.

    Only the last tokens are held: once all paths that can go on have a position in common, what lies
    before it is settled. So memory doesn't follow the text's length.
    """
    out: list[Span] = []
    coming = tokens_of(text, lo, hi)
    tokens: list[Token] = []
    best, back = [0.0], [(0, 0)]
    first, limit = 0, FLUSH  # the first position that isn't settled

    def settle(j: int) -> None:
        found = []
        while j > first:
            i, kind = back[j]
            if kind:
                found.append((kind - 1, tokens[i].start, tokens[j - 1].end))
            j = i
        out.extend(found[::-1])

    ahead = next(coming, None)
    while ahead is not None:
        tokens.append(ahead)
        ahead = next(coming, None)
        j = len(tokens)
        top, origin = best[j - 1], (j - 1, 0)
        if tokens[j - 1].ends:
            after = w.of("after=" + (ahead.plain if ahead else "$"))
            right, follows = ahead is not None and tokens[j - 1].end == ahead.start, _number(ahead)
            for i, form in bodies(text, tokens, j, first):
                own = w.of(form, body_features)
                before = w.of("before=" + (tokens[i - 1].plain if i else "^"))
                before2 = w.of("before2=" + (tokens[i - 2].plain if i > 1 else "^"))
                glued = w.of(f"glued={i > 0 and tokens[i - 1].end == tokens[i].start}{right}")
                sides = w.of("sides=" + _number(tokens[i - 1] if i else None) + follows)
                if best[i] + own[0] + before[0] + before2[0] + after[0] + glued[0] + sides[0] > top:
                    for kind in range(1, len(KINDS) + 1):
                        s = best[i] + own[kind] + before[kind] + before2[kind] + after[kind] + glued[kind] + sides[kind]
                        if s > top:
                            top, origin = s, (i, kind)
        best.append(top)
        back.append(origin)
        if j >= limit:
            live = set(range(max(first, j - LONGEST + 1), j + 1))
            while len(live) > 1:
                last = max(live)
                live.remove(last)
                live.add(back[last][0] if last > first else first)
            common = live.pop()
            settle(common)
            drop = max(0, common - 2)  # two tokens more for the features of what follows
            tokens, best, back = tokens[drop:], best[drop:], [(i - drop, kind) for i, kind in back[drop:]]
            first = common - drop
            limit = max(FLUSH, 2 * len(tokens))
    settle(len(tokens))
    return out


def _add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b))) if a > -1e300 and b > -1e300 else max(a, b)


def _gradient(text: str, gold: set[Span], w: dict) -> dict:
    """Observed minus expected features of one labelled text: the gradient of its log-likelihood."""
    tokens = list(tokens_of(text))
    n, low = len(tokens), -1e301
    by_end = _lattice(text, tokens, w)
    forward, backward = [0.0] + [low] * n, [low] * n + [0.0]
    for j in range(1, n + 1):
        for i, _, s, _ in by_end[j]:
            forward[j] = _add(forward[j], forward[i] + s)
    for j in range(n, 0, -1):
        for i, _, s, _ in by_end[j]:
            backward[i] = _add(backward[i], backward[j] + s)
    out: dict = {}
    for j in range(1, n + 1):
        for i, kind, s, found in by_end[j]:
            if kind:
                p = ((kind - 1, tokens[i].start, tokens[j - 1].end) in gold) - math.exp(min(0.0, forward[i] + s + backward[j] - forward[n]))
                if abs(p) > 1e-4:
                    for x in found:
                        out[x, kind - 1] = out.get((x, kind - 1), 0.0) + p
    return out


def examples(n: int, seed: int = 7) -> list[tuple[str, set[Span]]]:
    """Labelled windows made up here: entities of every kind in invented prose, and numbers that are none."""
    r = random.Random(seed)
    syllable = "ba de ko lu mi ra so ti ver en schal tion que ent er an".split()

    def word() -> str:
        return "".join(r.choice(syllable) for _ in range(r.randint(1, 4)))

    def digits(n: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(n))

    def card() -> str:
        n = r.choice((13, 14, 15, 16, 16, 16, 19))
        d = digits(n - 1)
        d += next(c for c in "0123456789" if luhn(d + c))
        return r.choice((d, " ".join(d[k : k + 4] for k in range(0, n, 4)), "-".join(d[k : k + 4] for k in range(0, n, 4))))

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def mixed(letters: str, n: int) -> str:
        body = [r.choice(letters + "0123456789") for _ in range(n)]
        body[r.randrange(1, n)], body[0] = r.choice("0123456789"), r.choice(letters)
        return "".join(body)

    def secret() -> str:
        return r.choice((lambda: mixed("abcdef", r.choice((32, 40, 40, 64))), lambda: mixed("abcdef", r.choice((32, 40, 40, 64))), lambda: "AKIA" + mixed(upper + upper, 16), lambda: mixed(upper + lower, r.choice((24, 32, 36)))))()

    def table(longest: int) -> str:
        n, columns, gap = r.randint(4, 48), r.randint(3, 8), r.choice((" ", " ", " ", "  ", ", ", ",", ",", " | ", "-", ";"))
        width, places = r.choice((0, 0, 3, 4, 4)), r.choice((0, 0, 0, 1, 2, 2))
        cells = [digits(width or r.randint(1, longest)) + ("." + digits(places) if places else "") for _ in range(n)]
        return "".join(c + ("\n" if k % columns == columns - 1 else gap) for k, c in enumerate(cells)) + digits(width or 2)

    made = {
        0: lambda: f"{word()}{r.choice(('.', '_', ''))}{r.choice((word(), digits(2)))}@{word()}{r.choice(('', digits(1)))}.{r.choice(('example.com', 'org', 'net', 'de'))}",
        1: lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        2: card,
        3: lambda: r.choice((f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(7)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}")),
        4: lambda: secret(),
    }
    lead = {2: ("card ", "card: ", ""), 3: ("call ", "phone: ", "tel ", ""), 4: ('token = "', 'key = "', 'secret: "', "api_key = '", "password=")}
    named = ("password=", "password: ", "passwd=", "pwd=")
    def no_card() -> str:
        d = digits(r.choice((13, 15, 16, 16, 16, 16, 19)))
        return d if not luhn(d) else d[:-1] + str((int(d[-1]) + 1) % 10)

    def no_address() -> str:
        parts = [str(r.randint(0, 255)) for _ in range(4)]
        parts[r.randrange(4)] = str(r.randint(256, 999))
        return ".".join(parts)

    none = [
        no_card, no_card, no_card, no_address,
        lambda: f"version {digits(1)}.", lambda: f"Version {digits(1)}.{digits(1)}.", lambda: f"in {r.randint(1900, 2030)}", lambda: f"{digits(3)} {word()}", lambda: f"{digits(1)}.{digits(1)}.{digits(2)}",
        lambda: f"{r.randint(1, 999)},{digits(3)}", lambda: f"{r.randint(2000, 2030)}-0{r.randint(1, 9)}-1{digits(1)}", lambda: f"section {digits(1)}.{digits(1)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"BY-NC {digits(1)}.0", lambda: f"no. {digits(r.randint(5, 12))}", lambda: f"@{word()}",
        *[lambda: table(4)] * 4, *[lambda: table(7)] * 3, lambda: f"{word()}{digits(r.randint(1, 3))}{word()}", lambda: f"{word()}: " + " ".join(f"{k}00" for k in range(1, r.randint(4, 9))),
    ]
    out = []
    for _ in range(n):
        text, gold = "", set()
        for _ in range(r.randint(1, 3)):
            text += " ".join(word() for _ in range(r.randint(0, 4))) + " "
            if r.random() < 0.55:
                kind = r.randrange(len(KINDS))
                before = r.choice(lead.get(kind, ("",)))
                body = made[kind]()
                if body.startswith("AKIA"):
                    before = r.choice(("", "key ", "id: ", before))
                elif kind == 4 and r.random() < 0.25:
                    before, body = r.choice(named), f"{word()}{digits(r.randint(1, 4))}{r.choice(('', word()))}"
                if r.random() < 0.1:
                    body, before = body.upper(), before.upper()
                text += before
                gold.add((kind, len(text), len(text) + len(body)))
                if kind in (1, 2, 3) and not before and r.random() < 0.4:  # two in a row, as one match of a pattern may hold
                    text, kind, body = text + body + " ", (more := r.choice((1, 2, 3))), made[more]()
                    gold.add((kind, len(text), len(text) + len(body)))
                text += body + ('"' if before.endswith('"') else "'" if before.endswith("'") else "") + r.choice(("", "", ".", ",", "!!", "***", "###"))
            else:
                text += r.choice(none)()
            text += r.choice((" ", " ", "\n"))
        out.append((text, gold))
    return out


@cache
def weights(n: int = 800, passes: int = 4, rate: float = 0.5, decay: float = 2e-4) -> Weights:
    """The model: maximum likelihood on ``examples(n)`` by AdaGrad. The driver learns it in seconds and broadcasts it (under 1 MB)."""
    w: dict = {}
    squares: dict = {}
    made = examples(n)
    for _ in range(passes):
        for text, gold in made:
            for k, g in _gradient(text, gold, w).items():
                g -= decay * w.get(k, 0.0)
                squares[k] = squares.get(k, 1e-2) + g * g
                w[k] = w.get(k, 0.0) + rate * g / math.sqrt(squares[k])
    return Weights({k: x for k, x in w.items() if abs(x) > 1e-3})


def windows(text: str, base: list[Span]) -> Iterator[tuple[int, int]]:
    """Stretches of text, apart from one another, whose decoding adds to the base spans what that of the whole text does.

    A stretch goes REACH tokens beyond its digits and @ signs on both sides, so no entity crosses its ends and
    features see what they see in the whole text. Left out are stretches whose triggers all lie in base
    spans: whatever is found there meets one of these, and they stay.
    """
    own = sorted((s, e) for _, s, e in base)
    k, lo, hi, wanted = 0, -1, -1, False  # lo and hi: of the stretch at hand, without its tokens on the right

    def left(at: int) -> int:
        size = 256
        while True:
            found = [m.start() for m in TOKEN.finditer(text, max(0, at - size), at)]
            if len(found) > REACH:
                return found[-REACH]
            if size >= at:
                return 0
            size *= 4

    def right(at: int) -> int:
        found = [m.end() for m in islice(TOKEN.finditer(text, at), REACH)]
        return found[-1] if len(found) == REACH else len(text)

    for m in TRIGGER.finditer(text):
        s, e = m.span()
        if lo >= 0 and s - hi > REACH and right(hi) < (start := left(s)):
            if wanted:
                yield lo, right(hi)
            lo, wanted = start, False
        elif lo < 0:
            lo = left(s)
        hi = e
        if not wanted:
            at = s
            while at < e:
                while k < len(own) and own[k][1] <= at:
                    k += 1
                if k == len(own) or own[k][0] > at:
                    wanted = True
                    break
                at = min(e, own[k][1])
                rest = SURE.search(text, at, e)
                at = rest.start() if rest else e
    if wanted:
        yield lo, right(hi)


def all_spans(text: str, w: Weights) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), by kind and start. A span of the model that overlaps a base span is left out."""
    base = base_spans(text)
    more = [span for lo, hi in windows(text, base) for span in decode(text, w, lo, hi)]
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    longest = 0
    reach = []
    for _, e in taken:
        longest = max(longest, e)
        reach.append(longest)
    free = [x for x in more if not ((k := bisect.bisect_left(starts, x[2])) and reach[k - 1] > x[1])]
    return sorted(base), sorted(base + free)


def _said(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for k, s, e in spans])


FOUND = "struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,n_secret:bigint,base:string,spans:string>"


def find(text: Column) -> Column:
    """struct of FOUND for each whole text (null: empty): counts of all base spans (n_secret: of the model's), and spans.

    ``base`` and ``spans`` are kind:start:end by kind and start, in code points, end exclusive. Rows stay
    where they are; only the text goes to Python.
    """
    shared = SparkSession.getActiveSession().sparkContext.broadcast(weights())

    @F.pandas_udf(FOUND)
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for texts in series:
            rows = []
            for t in texts:
                base, every = all_spans(t or "", w)
                counts = [sum(1 for s in base if s[0] == k) for k in range(BASE)] + [sum(1 for s in every if s[0] == BASE)]
                rows.append((*counts, _said(base), _said(every)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "n_secret", "base", "spans"])

    return run(F.coalesce(text, F.lit("")))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret) of every row.

    A null or empty text has no span. A row depends on its text alone, so null and repeated ids are fine, an
    empty table gives none, and extra columns are not read. No shuffle; memory follows the longest text, not what
    the model makes of it.
    """
    rows = docs.select(F.col(id_col), find(F.col(text_col)).alias("_f"))
    return rows.select(id_col, "_f.n_email", "_f.n_ip", "_f.n_card", "_f.n_phone", F.sha2(F.col("_f.base"), 256).alias("base_sha256"), F.col("_f.spans").alias("spans"), "_f.n_secret")


def redacted_text(text: str, w: Weights) -> str:
    """``text`` with each span replaced by its kind in angle brackets; of overlapping spans the first stays."""
    _, spans = all_spans(text, w)
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{KINDS[kind].upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(text: Column) -> Column:
    """``text`` without its personal data; null stays null, and a text without any is returned as it was. Rows stay where they are."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(weights())

    @F.pandas_udf("string")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value
        for texts in series:
            yield pd.Series([t if t is None else redacted_text(t, w) for t in texts], dtype=object)

    return run(text)
