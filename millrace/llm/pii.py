"""Personal data: pattern spans, and more spans from a linear-chain conditional random field (CRF).

Base spans are matches of four kinds (email, ip, card, phone) that pass their checks; a failing match is dropped and its text
not searched again. The CRF labels words (maximal runs without white space) with O, or B and I of each of its
kinds (telephone and personal numbers, personal names, street addresses), from word shapes with letter case, affixes and
neighbouring words. Only words with a digit or an upper-case letter can have a label other than O, and so can lower-case ones between
two of them: a text decodes exactly by its maximal runs of such words, each with O on both sides. Viterbi runs over all runs of
one length of a chunk of documents at once. A name or address of too many words, or with the end of a sentence inside, is
dropped, and so are model spans that overlap a base span; base spans always stay.

The model is fitted on the driver to a small labelled table (`SENTENCES`, or a DataFrame of the same form with at most `max_train`
rows, those of least text checksum). Scoring is one pass over whole texts with no shuffle. A name is found by its cues and its
form, since a list of names is no part of the method: a name without a cue beside it stays unmarked.

Offsets count code points, end exclusive. Edge cases: a null or empty text has no spans; repeated rows each get a row; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytewords import SPACED, U, Words, mix, utf8, words

KINDS = ("email", "ip", "card", "phone", "tel", "nid", "name", "addr")
BASE = KINDS[:4]
LABELS = ("O", *(f"{at}-{kind}" for kind in KINDS[4:] for at in "BI"))
BUCKETS = 1 << 14
#: The labelled table: sentences with [kind|text] marks; tel: telephone numbers, nid: personal and account
#: numbers, name: personal names, addr: street addresses.
SENTENCES = """
Call me at [tel|(743) 555-3824] before noon.
My number is [tel|555-0142] and I am home after six.
Phone: [tel|212-555-0187] ext. 4
Tel. [tel|030 1234567] oder per Fax.
Fax [tel|(020) 7946 0958] for orders
Reach us on [tel|0800 555 0199] any day.
Mobile [tel|07700 900123] or write to us
You can ring [tel|(415) 555-2671] tomorrow.
Telefon [tel|089 5550 123] bitte nach 18 Uhr
Appelez le [tel|01 99 00 12 34] avant 17 heures.
Mon portable est le [tel|06 39 98 12 34] merci
Llame al [tel|91 555 12 34] por la tarde.
Contact [tel|1-800-555-0123] or visit room 204
cell: [tel|(310) 555-0100], office 12
please text [tel|646-555-0173] when you arrive
Her SSN is [nid|219-09-9999] on the form.
SSN: [nid|078-05-1120]
social security number [nid|457-55-5462] was listed
Tax id [nid|12-3456789] belongs to the firm.
Passport no. [nid|C01X00T47] expires in 2031.
passport number [nid|X4RTBPFW4] was lost
IBAN [nid|DE89 3704 0044 0532 0130 00] is the account.
iban: [nid|GB29NWBK60161331926819] please
Kontonummer [nid|0532013000] bei der Bank
National insurance [nid|QQ123456C] on file.
DNI [nid|12345678Z] de la persona
Ausweis Nr. [nid|T220001293] ist gültig
The year 2019 had 365 days and 12 months.
In 1999 about 4500 people came, 30 more than in 1998.
Chapter 7 and page 143 of volume 2.
It costs 19.99 or 20 dollars for 3 pieces.
On 2024-05-17 at 10:45 the train left platform 9.
The meeting of 12/05/2021 lasted 90 minutes.
Version 3.11.4 replaced 2.7 in 2020.
Order 66231 has 14 items of 250 g.
Room 12B is on floor 3, seat 14C.
The ratio 16:9 is wider than 4:3.
About 1,250,000 readers and 75% of 3,200 voters
Section 4.2.1 defines x1 and y2 as 0.5.
Between 1914 and 1918, 1939-1945 again.
Population 83,000,000 in 2021, up 0.4%.
The score was 3-1 after 90 minutes, 10-7 before.
A4 paper is 210 x 297 mm, B5 is smaller.
Add 250ml of milk and 3 eggs, bake 45min at 180C.
Im Jahr 2018 waren es 42 Prozent, 2019 nur 38.
En 1789 il y avait 28 millions, en 1850 36 millions.
El 15 de mayo de 2020 hubo 230 casos nuevos.
MP3 and H2O and CO2 are not numbers; 42 is.
The model T-800 and the 747-400 of 1989
Flight LH441 leaves gate B22 at 19:05.
GB IBAN [nid|GB29 NWBK 6016 1331 9268 19] was charged.
Her IBAN is [nid|NL91 ABNA 0417 1643 00] she says
My name is [name|Ann Lee] and I live here.
my name is [name|Peter Braun] from Leipzig
Please ask for [name|Maria Lopez] at the desk.
Dear [name|John Smith], thank you for the note.
Dear Mr. [name|Smith], we write about the bill.
Mr. [name|Arthur Hill] signed the lease.
Mrs. [name|Olga Petrova] will call back.
Ms [name|Jane Doe] agreed to the terms.
Dr. [name|Emil Weber] sees patients today.
Herr [name|Hans Keller] wohnt nebenan.
Frau [name|Eva Klein] ist krank.
Mein Name ist [name|Lena Vogel] und ich schreibe Ihnen.
Je m'appelle [name|Luc Moreau] et je travaille ici.
Me llamo [name|Pablo Ruiz] y soy de aquí.
Contact: [name|Nora Field] in sales
Signed, [name|Tom Baker]
Regards, [name|Alice Brown]
Patient name: [name|Carl Jonas] admitted in May
Send it to [addr|221 Baker Street] please.
She lives at [addr|14 Elm Road] near the park.
Address: [addr|1600 Pine Avenue] Springfield
Our office is at [addr|75 Harbor Drive] now.
Visit [addr|9 King Lane] or call.
Er wohnt in der [addr|Lindenstraße 12] im Hof.
Adresse: [addr|Hauptstraße 5] in Berlin
Wir sind in die [addr|Gartenweg 27] gezogen.
Il habite [addr|12 Rue Pasteur] depuis mai.
Vive en la [addr|Calle Mayor 8] con su madre.
The Great River runs through Old Town in April.
Many people in New York and South Wales read The Times.
Der Hund und die Katze schlafen im Haus am Fluss.
Die Stadt Berlin hat viele Parks und Museen.
La Ville de Paris et la Seine sont belles.
El Museo del Prado está en Madrid, la capital.
Chapter One: The Road to Nowhere
However, It Was Late. Then We Left.
University of Oxford Press, Second Edition
Monday and Tuesday in March, before Easter Sunday.
In London the Queen spoke to Parliament.
NASA and ESA sent a probe to Mars.
This is the end. That was all. Here we are.
Buy Now! Best Price! Click Here
I think that I know what You mean by This.
Our street is long and the road is wide.
My name means river in the old language.
Dear reader, this is the first page.
""".strip().splitlines()

#: More labelled rows are made by a rule: every cue with values of some of the forms of its kind. In a form, 9 stands for any digit,
#: A for any capital, and Name for a made-up capitalised word.
CUES = {
    "tel": "call|phone:|tel.|mobile|fax|telephone|ring me on|text|my number is|reach me at|Telefon|Handy|appelez le|téléphone|teléfono|llame al|contact",
    "nid": "SSN|SSN:|social security number|passport no.|passport number|IBAN|iban:|account number|tax id|national insurance|DNI|Ausweis Nr.|Kontonummer|numéro de sécurité|insurance no.|licence number",
    "name": "my name is|Mr.|Mrs.|Ms|Dr.|Dear|Dear Mr.|Herr|Frau|Mein Name ist|je m'appelle|me llamo|Señor|Madame|Contact:|Signed,|Regards,|Sincerely,|patient name:|ask for",
    "addr": "lives at|address:|Address:|office at|send it to|visit|delivered to|wohnt in der|Adresse:|habite|vive en la|moved to",
}
FORMS = {
    "tel": "(999) 999-9999|999-999-9999|99999 999999|999 9999999|999-9999|9-999-999-9999|0999 999 999|99 99 99 99 99|999 999 99 99|(0999) 999999|9999999999|999.999.9999",
    "nid": "999-99-9999|99-9999999|A99A99A99|AA99 9999 9999 9999 9999 99|AA99AAAA99999999999999|9999999999|AA999999A|99999999A|A999999999|AA99 AAAA 9999 9999 9999 99|AA9999999|AA99 AAAA 9999 9999 99",
    "name": "Name Name|Name|Name A. Name|Name Name-Name|Name Name Name",
    "addr": "99 Name Street|999 Name Road|99 Name Avenue|9 Name Lane|999 Name Drive|Namestraße 99|Nameweg 9|99 Rue Name|Calle Name 99|9999 Name Boulevard",
}
PLAIN = "Name|Name Name|9999|99|999|9.9|99%|99-99|99.99|9,999|99:99|9999-99-99|99/99/9999|A9|AA|AAA999|the|and|99 km|9999 Name|Name 9"
SYLLABLES = "ba ri so lu te ma no vi ka del mon far gus pel tan wi or en ha jo".split()


def by_rule(seed: int = 3, forms: int = 4) -> list[str]:
    """Labelled rows: each cue with some forms of its kind, and as many rows without personal data."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]

    def filled(form: str) -> str:
        form = re.sub("Name", lambda _: "".join(pick(SYLLABLES) for _ in range(int(rng.integers(2, 4)))).capitalize(), form)
        return re.sub(r"9|\bA\b|A(?=[A9])|(?<=9)A", lambda m: str(rng.integers(10)) if m[0] == "9" else chr(65 + int(rng.integers(26))), form)

    around = "".join(s for s in SYLLABLES).lower()
    word = lambda: around[(i := int(rng.integers(len(around) - 8))) : i + int(rng.integers(2, 8))]
    out = []
    for kind, cues in CUES.items():
        for cue in cues.split("|"):
            for _ in range(forms):
                out.append(f"{word()} {word()} {cue} [{kind}|{filled(pick(FORMS[kind].split('|')))}]{pick(['', '.', ',', ''])} {word()} {word()}")
                for _ in range(3):  # prose: sentences with capitals, marks and plain numbers
                    capital = rng.random() < 0.6
                    row = [word().capitalize() if capital and rng.random() < 0.3 else word() if rng.random() < 0.75 else filled(pick(PLAIN.split("|"))) for _ in range(10)]
                    out.append(" ".join(w + pick(["", "", "", "", ".", ",", "!"]) for w in row))
            again = word().capitalize() + pick(["", ".", "!"])
            out.append(" ".join([again] * int(rng.integers(3, 9))))
    return out


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match never ends inside a run of digits, so none starts inside one: the look-behind only saves time.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@domain, in linear time: a match starts where its run of local characters does."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        done = m.end() if m else at + 1
        if m:
            out.append((a, m.end()))
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_ALNUM = _DIGIT | _CAPITAL
_ALNUM[97:123] = True
#: Of a shape: 0 lower-case letter, 1 digit, 2 other mark, 3 capital, 4 byte of another script, else the mark itself.
_KIND = np.full(256, 2, np.uint8)
_KIND[97:123], _KIND[48:58], _KIND[65:91], _KIND[128:] = 0, 1, 3, 4
for _i, _c in enumerate(b"()+-./,:;%#'\""):
    _KIND[_c] = 5 + _i
#: Changes of kind that a shape tells apart.
SHAPE = 12


def runs(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of each maximal run of words with a digit or a capital, and of single words between two of them."""
    n = len(w.start)
    marks = np.concatenate([[0], np.cumsum(_DIGIT[w.raw] | _CAPITAL[w.raw])])
    some = marks[w.end] > marks[w.start]
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = w.row[1:] == w.row[:-1]
    if n > 2:
        some[1:-1] |= some[:-2] & some[2:] & same[:-1] & same[1:]
    opens, shuts = some.copy(), some.copy()
    opens[1:] &= ~some[:-1] | ~same
    shuts[:-1] &= ~some[1:] | ~same
    a = np.flatnonzero(opens)
    return a, np.flatnonzero(shuts) + 1 - a


def word_features(w: Words, at: np.ndarray) -> np.ndarray:
    """Hashed features of the words at `at`, as many for each."""
    first, last = w.head[w.row[at]], w.head[w.row[at] + 1] - 1
    start, end = w.start[at], w.end[at]
    kind = _KIND[w.raw]
    turn = np.ones(len(kind), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[w.start] = True
    # A shape: the kinds of a word, each run of one kind once, as far as SHAPE of them.
    place = np.flatnonzero(turn)
    head = np.searchsorted(place, start)
    stop = np.searchsorted(place, end)
    shape = np.zeros(len(at), U)
    for i in range(SHAPE):
        p = head + i
        has = p < stop
        if not has.any():
            break
        shape[has] = shape[has] * U(31) + kind[place[p[has]]].astype(U) + U(1)
    shape = mix(shape)
    count = lambda k: np.diff(np.concatenate([[0], np.cumsum(kind == k)])[np.stack([start, end])], axis=0)[0]
    digits, letters = np.minimum(count(1), 20).astype(U), np.minimum(count(0) + count(3), 20).astype(U)
    affix = lambda p: np.bitwise_or.reduce([w.low[np.clip(q, start, end - 1)].astype(U) << U(8 * i) for i, q in enumerate(p)])
    no = U(0xFFFF)

    def cue(step: int) -> np.ndarray:
        p = at + step
        ok = (p >= first) & (p <= last)
        return np.where(ok, w.hash[np.clip(p, 0, len(w.hash) - 1)], no)

    def cased(step: int) -> np.ndarray:
        """Whether the neighbour starts with a capital, a digit, or neither; or isn't there."""
        p = at + step
        ok = (p >= first) & (p <= last)
        return np.where(ok, kind[w.start[np.clip(p, 0, len(w.hash) - 1)]], 31).astype(U)

    def tail(step: int) -> np.ndarray:
        """The kind of the neighbour's last byte."""
        p = at + step
        ok = (p >= first) & (p <= last)
        return np.where(ok, kind[w.end[np.clip(p, 0, len(w.hash) - 1)] - 1], 31).astype(U)

    parts = [shape, digits * U(32) + letters, digits, np.zeros(len(at), U), cue(-1), cue(-2), cue(1), shape * U(31) + digits, mix(shape) ^ cue(-1)]
    twice = cue(-1) == w.hash[at]
    parts += [affix((start, start + 1, start + 2)), affix((end - 1, end - 2, end - 3)), w.hash[at], cased(-1) * U(32) + cased(1), mix(cased(1)) ^ shape, tail(-1) * U(32) + kind[end - 1].astype(U), mix(tail(-1)) ^ shape, twice.astype(U)]
    return np.stack([mix(p + U(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) & U(BUCKETS - 1) for k, p in enumerate(parts)], 1).astype(np.int64)


@dataclass
class Crf:
    emit: np.ndarray  # BUCKETS x labels
    move: np.ndarray  # labels x labels

    def decode(self, f: np.ndarray) -> np.ndarray:
        """Best label sequences of runs of one length: f is runs x length x features. O stands before and after each run."""
        e = self.emit[f].sum(2)
        best, back = self.move[0] + e[:, 0], []
        for t in range(1, f.shape[1]):
            s = best[:, :, None] + self.move[None]
            back.append(s.argmax(1))
            best = s.max(1) + e[:, t]
        path = [(best + self.move[:, 0]).argmax(1)]
        for b in reversed(back):
            path.append(np.take_along_axis(b, path[-1][:, None], 1)[:, 0])
        return np.stack(path[::-1], 1)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def gradient(p: list[np.ndarray], groups: list[tuple[np.ndarray, np.ndarray]]) -> tuple[float, list[np.ndarray], np.ndarray]:
    """(log-likelihood, its gradients by label of each word of all groups, and by move)."""
    k, ll, all_d, g = len(p[1]), 0.0, [], np.zeros_like(p[1])
    for f, y in groups:
        own = np.empty((*y.shape, k))
        e = p[0][f].sum(2)
        n, t = y.shape
        a, z = [p[1][0] + e[:, 0]], [np.broadcast_to(p[1][:, 0], (n, k))]
        for i in range(1, t):
            a.append(_logsum(a[-1][:, :, None] + p[1][None], 1) + e[:, i])
            z.append(_logsum(p[1][None] + (e[:, t - i] + z[-1])[:, None, :], 2))
        z = z[::-1]
        total = _logsum(a[-1] + z[-1], 1)
        rows, before = np.arange(n), np.zeros(n, np.int64)
        for i in range(t):
            d = -np.exp(a[i] + z[i] - total[:, None])
            d[rows, y[:, i]] += 1
            own[:, i] = d
            ll += (e[rows, i, y[:, i]] + p[1][before, y[:, i]]).sum()
            before = y[:, i]
            if i == 0:
                g[0] += d.sum(0)
            else:
                both = np.exp(a[i - 1][:, :, None] + p[1][None] + (e[:, i] + z[i])[:, None, :] - total[:, None, None])
                g -= both.sum(0)
                np.add.at(g, (y[:, i - 1], y[:, i]), 1)
            if i == t - 1:
                g[:, 0] += d.sum(0)
        ll += p[1][before, 0].sum() - total.sum()
        all_d.append(own.reshape(-1, k))
    return ll, np.concatenate(all_d), g


def fit(groups: list[tuple[np.ndarray, np.ndarray]], steps: int = 150, rate: float = 0.1, decay: float = 0.002) -> Crf:
    """groups: features (runs x length x features) and labels (runs x length), by length. Maximum likelihood by Adam."""
    k = len(LABELS)
    p = [np.zeros((BUCKETS, k)), np.zeros((k, k))]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    barred = np.zeros((k, k), bool)
    for i, name in enumerate(LABELS):  # I- only follows B- or I- of its kind
        if name[0] == "I":
            barred[:, i] = [x[2:] != name[2:] for x in LABELS]
    # Words of all groups in one row, and for each bucket that occurs the words that have it: sums by bucket are runs of these.
    flat = np.concatenate([f.reshape(-1, f.shape[2]) for f, _ in groups])
    order = np.argsort(flat, axis=None, kind="stable")
    bucket, starts = np.unique(flat.ravel()[order], return_index=True)
    word = order // flat.shape[1]
    for step in range(1, steps + 1):
        p[1][barred] = -30.0
        _, by_word, by_move = gradient(p, groups)
        g = [-decay * p[0], by_move - decay * p[1]]
        g[0][bucket] += np.add.reduceat(by_word[word], starts)
        for i in range(2):
            m[i] = 0.9 * m[i] + 0.1 * g[i]
            v[i] = 0.99 * v[i] + 0.01 * g[i] ** 2
            p[i] = p[i] + rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-6)
    p[1][barred] = -1e9
    return Crf(*p)


def marked(sentence: str) -> tuple[str, list[tuple[int, int, str]]]:
    """A sentence without its marks, and (start, end, kind) of each."""
    out, spans = "", []
    for part in re.split(r"(\[\w+\|[^\]]*\])", sentence):
        m = re.fullmatch(r"\[(\w+)\|([^\]]*)\]", part)
        if m:
            spans.append((len(out), len(out) + len(m[2]), m[1]))
        out += m[2] if m else part
    return out, spans


def train(sentences: list[str] | None = None) -> Crf:
    """Fit to sentences with [kind|text] marks; without any, to SENTENCES and those made by rule."""
    pairs = [marked(s) for s in (SENTENCES + by_rule() if sentences is None else sentences)]
    by: dict[int, list[tuple[np.ndarray, list[int]]]] = {}
    for w in words(pa.array([t for t, _ in pairs], pa.string()), SPACED):
        at = _code_points(w)
        a, n = runs(w)
        for i, k in zip(a.tolist(), n.tolist(), strict=True):
            spans, zero = pairs[w.first + w.row[i]][1], _row_start(w, at, w.row[i])
            y, inside = [], None
            for j in range(i, i + k):
                s, e = at[w.start[j]] - zero, at[w.end[j]] - zero
                hit = next(((b, kind) for b, c, kind in spans if s < c and e > b), None)
                y.append(LABELS.index(f"{'I' if hit == inside else 'B'}-{hit[1]}") if hit else 0)
                inside = hit
            by.setdefault(k, []).append((word_features(w, np.arange(i, i + k)), y))
    return fit([(np.stack([f for f, _ in g]), np.array([y for _, y in g])) for g in by.values()])


def train_table(labelled: DataFrame, column: str = "sentence", max_train: int = 2000) -> Crf:
    rows = labelled.select(F.col(column).alias("s")).filter("s is not null").orderBy(F.crc32(F.col("s").cast("binary")), "s").limit(max_train)
    return train([r.s for r in rows.collect()])


def _code_points(w: Words) -> np.ndarray:
    """Code points before each byte of the chunk."""
    return np.concatenate([[0], np.cumsum((w.low & 0xC0) != 0x80)])


def _row_start(w: Words, at: np.ndarray, row: int) -> int:
    return int(at[w.bounds[row]])


#: Kinds that are made of words. No name or address repeats its words over and over, or goes on behind a sentence's end; none is too long.
WORDY = ("name", "addr")


def _broken(w: Words, i: int, j: int) -> bool:
    """Whether a sentence or a clause ends inside words i..j-1, behind a word of two bytes or more; or they are over twice as many as
    different ones."""
    ends = any(w.raw[e - 1] in b".!?,;:" and e - s > 2 for s, e in zip(w.start[i : j - 1], w.end[i : j - 1], strict=True))
    return ends or j - i > 2 * len(np.unique(w.hash[i:j]))


def model_spans(w: Words, crf: Crf) -> list[tuple[int, int, int, int]]:
    """(row, kind number, start, end) of what the model finds in a chunk; marks around a span are cut off."""
    a, n = runs(w)
    out = []
    at = None
    if not len(a):
        return out
    head = np.concatenate([[0], np.cumsum(n)])[:-1]  # of each run, its first word among the words of runs
    f = word_features(w, np.repeat(a - head, n) + np.arange(n.sum()))
    for k in np.unique(n).tolist():
        first = a[n == k]
        y = crf.decode(f[head[n == k][:, None] + np.arange(k)])
        for r in np.flatnonzero((y > 0).any(1)).tolist():
            at = _code_points(w) if at is None else at
            j = 0
            while j < k:
                if not y[r, j]:
                    j += 1
                    continue
                kind, i = LABELS[y[r, j]][2:], j
                j += 1
                while j < k and LABELS[y[r, j]] == f"I-{kind}":
                    j += 1
                if kind in WORDY and _broken(w, int(first[r]) + i, int(first[r]) + j):
                    continue
                s, e = int(w.start[first[r] + i]), int(w.end[first[r] + j - 1])
                while s < e and w.raw[s] < 128 and not (_ALNUM[w.raw[s]] or w.raw[s] in b"(+"):
                    s += 1
                while e > s and w.raw[e - 1] < 128 and not (_ALNUM[w.raw[e - 1]] or w.raw[e - 1] == 41):
                    e -= 1
                if s < e:
                    row = int(w.row[first[r]])
                    zero = _row_start(w, at, row)
                    out.append((row, KINDS.index(kind), int(at[s]) - zero, int(at[e]) - zero))
    return out


def scan(docs: DataFrame, crf: Crf, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, spans (array of kind, start, stop, text), base ones first by kind, then the model's, each by start."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    kind = docs.schema[doc_id].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("text", pa.string())])

    def run(batches):
        model = shared.value
        for b in batches:
            found: list[list[tuple[int, int, int]]] = [[] for _ in range(b.num_rows)]
            raw, at = utf8(b.column(1))
            some = np.concatenate([[0], np.cumsum(_DIGIT[raw] | _CAPITAL[raw] | (raw == 64))])
            texts = {}
            for r in np.flatnonzero(np.diff(some[at]) > 0).tolist():
                texts[r] = raw[at[r] : at[r + 1]].tobytes().decode()
                found[r] = base_spans(texts[r])
            for w in words(b.column(1), SPACED):
                extra: dict[int, list] = {}
                for row, k, s, e in model_spans(w, model):
                    extra.setdefault(w.first + row, []).append((k, s, e))
                for r, more in extra.items():
                    base = list(found[r])
                    found[r] = base + sorted(x for x in more if not any(x[1] < e and s < x[2] for _, s, e in base))
            rows = [[{"kind": KINDS[k], "start": s, "stop": e, "text": texts[r][s:e]} for k, s, e in f] for r, f in enumerate(found)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(item))], ["doc_id", "spans"])

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,stop:bigint,text:string>>")
