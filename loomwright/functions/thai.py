"""Thai syllables: a trie of syllable patterns, and the cheapest way through it.

Thai has no spaces between words, and a syllable's vowel may stand before, above,
below, after or around its initial, or not be written. The patterns say which signs
a syllable may have; they are the paths of a trie whose edges are classes of
signs. From each place of a text all syllables that can begin there are read off
the trie, and dynamic programming picks the parse of least cost: few syllables,
and unwritten vowels only where nothing else fits.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import product

# Fixed values of Thai spelling.
CONSONANTS = "กขฃคฅฆงจฉชซฌญฎฏฐฑฒณดตถทธนบปผฝพฟภมยรลวศษสหฬอฮ"
TONES = "่้๊๋"
#: Never at the end of a syllable.
NOT_FINAL = "ฃฅฉฌผฝหอฮ"
#: Initials of two consonants that are one sound, or the second of which is led by the first.
CLUSTERS = "กร กล กว ขร ขล ขว คร คล คว ตร ปร ปล ผล พร พล ทร สร ศร ซร จร หง หญ หน หม หย หร หล หว อย".split()
#: Ends of two consonants, of which the second (or the first) isn't heard.
FINALS = "กร คร ตร ดร ทร ชร รถ รท รธ รณ ทธ ตถ ดธ ฒน จฉ".split()
#: Words whose syllables don't show in their spelling: linking syllables, silent ends, loans, and first vowels that aren't written.
IRREGULAR = {
    1: "ชาติ ญาติ ธาตุ เหตุ เมรุ เบรก ฟรี บล็อก แฟลต พุทธ",
    2: "สมบัติ พลัง กวี เจริญ นคร สวรรค์ เกษตร กษัตริย์ สมมติ ภูมิใจ สาเหตุ ขบวน ตลาด ขนม ถนน สบาย สนุก ทหาร อร่อย สมุด ตลอด ชนิด สนาม ขยัน ฉลาด ผลิต สมัย สยาม อดีต องุ่น สภาพ สมอง สมุทร สงบ จมูก จรวด ตลก ถนัด ทนาย ผสม ขโมย ขนุน ขนาด แสดง เสมอ เสนอ แถลง",
    3: "ผลไม้ รัฐบาล วิทยา ราชการ ธรรมชาติ โทรศัพท์ โทรทัศน์ ชนบท ปริญญา กรรมการ ทฤษฎี สุขภาพ ปรารถนา ศิลปะ จักรวาล พลเมือง คุณภาพ พัฒนา เทศบาล กิจกรรม รัชกาล ตุ๊กตา วาสนา ศาสนา พรรณนา มัธยม สกปรก อุทยาน มารยาท โฆษณา ปฏิบัติ สวัสดี พยายาม อนุญาต สถานี ธนาคาร พนักงาน อนาคต สมาคม นาฬิกา",
    4: "วัฒนธรรม พิพิธภัณฑ์ ประวัติศาสตร์ อุบัติเหตุ สัตวแพทย์ วิศวกรรม นโยบาย เกษตรกร รัฐมนตรี คณิตศาสตร์ บุคลากร",
    5: "กรกฎาคม",
}

#: C initial, L second of a cluster, P any second consonant, F final, S second of a final pair, T tone mark; others are themselves. `a|b` are choices.
_ONE, _TONE, _END, _SOME = "C|CL", "|T", "|F|FS", "F|FS"
_AFTER = ["า", "ิ", "ี", "ึ", "ุ", "ู"]
_PATTERNS = [
    [_ONE, _TONE, "ะ"], [_ONE, "ั", _TONE, _SOME], [_ONE, "ั", _TONE, "วะ|ะ"], [_ONE, "ำ"], [_ONE, "T", "ำ"], [_ONE, "็"], [_ONE, "็อ", "F"],
    [_ONE, "า", _END], [_ONE, "Tา", _END], *([_ONE, v, _TONE, _END] for v in _AFTER[1:]), [_ONE, "ื", _TONE, "อ|F"],
    [_ONE, _TONE, "อ", _END], [_ONE, _TONE, "ว", _SOME], [_ONE, "รร", _END], [_ONE, _TONE, _SOME], [_ONE, "T"], ["ฤ|ฤๅ|Cฤ", "|F"],
    [_ONE, "ั", "Fิ|Fุ"],
]
#: With a vowel before the initial.
_LED = [
    ["เ", "*", _TONE, "|ะ|า|าะ|อ|อะ|F|FS|อF"], ["เ", "*", "็", "F"], ["เ", "*", "ิ", _TONE, _SOME], ["เ", "*", "ี", _TONE, "ย|ยะ|ยF"], ["เ", "*", "ื", _TONE, "อ|อะ|อF"],
    ["แ", "*", _TONE, "|ะ|F|FS"], ["แ", "*", "็", "F"], ["โ", "*", _TONE, "|ะ|F|FS"], ["ไ", "*", _TONE, "|ย"], ["ใ", "*", _TONE],
]
#: After a syllable: consonants that a mark silences.
_SILENT = "|C์|CC์|Cิ์|Cุ์|CCC์"
#: Cost of a syllable and of an irregular word (it goes before its parts); what an unwritten vowel alone adds, an initial of two that are no cluster, and a sign that fits nowhere.
_SYLLABLE, _WORD, _BARE, _LEADING, _STRAY = 10, 8, 6, 3, 100


def _trie() -> dict:
    """{edge: node}; where a pattern ends, "" has its (syllables, cost)."""
    root: dict = {}

    def add(edges: str, n: int, cost: int) -> None:
        node = root
        for e in edges:
            node = node.setdefault(e, {})
        node[""] = min(node.get("", (n, cost)), (n, cost), key=lambda x: x[1])

    def add_all(slots: list[str], n: int, cost: int) -> None:
        for parts in product(*(s.split("|") for s in slots)):
            add("".join(parts), n, cost)

    for p in _PATTERNS:
        add_all([*p, _SILENT], 1, _SYLLABLE)
    for p in _LED:
        add_all([_ONE if s == "*" else s for s in p] + [_SILENT], 1, _SYLLABLE)
        if len(p) > 2 and p[1] == "*":
            add_all(["CP" if s == "*" else s for s in p] + [_SILENT], 2, 2 * _SYLLABLE + _LEADING)
    add("C", 1, _SYLLABLE + _BARE)
    for n, words in IRREGULAR.items():
        for w in words.split():
            add(w, n, _WORD)
    return root


_ROOT = _trie()
_PAIRS, _ENDS = frozenset(CLUSTERS), frozenset(FINALS)
#: The edges by which a sign may be passed, whatever stands before it.
_EDGES = {c: (c, "C", "P") + (("F",) if c not in NOT_FINAL else ()) for c in CONSONANTS} | {t: (t, "T") for t in TONES}


def _from(text: str, i: int) -> list[tuple[int, int, int]]:
    """(end, syllables, cost) of what can begin at i."""
    out, at = [], [(_ROOT, i)]
    while at:
        node, k = at.pop()
        if "" in node:
            out.append((k, *node[""]))
        if k < len(text):
            c = text[k]
            pair = text[k - 1 : k + 1]
            edges = _EDGES.get(c, (c,)) + (("L",) if pair in _PAIRS else ()) + (("S",) if pair in _ENDS else ())
            at += [(node[e], k + 1) for e in edges if e in node]
    return out


def _parse(run: str) -> tuple[tuple[str, int], ...]:
    best: list[tuple[int, int, int]] = [(0, 0, 0)] + [(1 << 60, 0, 0)] * len(run)  # cost, where the last part begins, its syllables
    for i in range(len(run)):
        for end, n, cost in [*_from(run, i), (i + 1, 0, _STRAY)]:
            if best[i][0] + cost < best[end][0]:
                best[end] = (best[i][0] + cost, i, n)
    parts, i = [], len(run)
    while i:
        _, start, n = best[i]
        parts.append((run[start:i], n))
        i = start
    return tuple(reversed(parts))


_parsed = lru_cache(maxsize=10_000)(_parse)


class _Place(dict):
    """A place in a text: {next sign: (place after it, syllables gained)}, filled as texts need it.

    `under_way` has what may go on from here, the earliest begun first: a node of the trie,
    and cost and syllables up to its beginning, less those of the best parse up to here.
    These bound what follows, so places are few, and counting is a look-up for each sign.
    """

    __slots__ = ("under_way", "last")

    def __init__(self, under_way: list[tuple[dict, int, int]], last: str) -> None:
        self.under_way, self.last = under_way, last

    def __missing__(self, sign: str) -> tuple[_Place, int]:
        edges = _EDGES.get(sign, (sign,)) + (("L",) if self.last + sign in _PAIRS else ()) + (("S",) if self.last + sign in _ENDS else ())
        moved = [(node[e], cost, n) for node, cost, n in self.under_way for e in edges if e in node]
        ends = [(cost + node[""][1], n + node[""][0]) for node, cost, n in moved if "" in node]
        least, gained = min([*ends, (_STRAY, 0)], key=lambda x: x[0])  # the first of equal ones
        going = [(node, cost - least, n - gained) for node, cost, n in moved if len(node) > ("" in node)]
        last = sign if sign in _EDGES else ""
        key = (last, *((id(node), cost, n) for node, cost, n in going))
        if key not in _PLACES:
            if len(_PLACES) >= MOST_PLACES:
                for place in (_START, *_PLACES.values()):
                    place.clear()
                _PLACES.clear()
            _PLACES[key] = _Place([*going, (_ROOT, 0, 0)], last)
        self[sign] = _PLACES[key], gained
        return self[sign]


#: Places that a worker remembers; when there are more, all are forgotten.
MOST_PLACES = 10_000
_START = _Place([(_ROOT, 0, 0)], "")
_PLACES: dict[tuple, _Place] = {}


def _count(run: str) -> int:
    """The syllables of _parse()."""
    place, n = _START, 0
    for sign in run:
        place, more = place[sign]
        n += more
    return n


_counted = lru_cache(maxsize=10_000)(_count)


_RUN = re.compile("[ก-ฮะ-ฺเ-ๅ็-๎]+|[๐-๙]+|ๆ|[A-Za-z]+")


#: Signs of the longest run whose parts are remembered.
LONGEST_KEPT = 50


def _is_spelled(run: str) -> bool:
    return "ก" <= run[0] <= "๎" and run != "ๆ"


def parts(text: str) -> list[tuple[str, int]]:
    """Parts of a text with their syllables.

    Latin words, runs of Thai digits and the repetition sign count as one each. Signs
    that fit no syllable, other scripts, white space and punctuation count as none.
    A text is parsed in stretches of Thai letters, in time proportional to its length.
    """
    out: list[tuple[str, int]] = []
    for m in _RUN.finditer(text):
        run = m.group()
        out += (_parsed if len(run) <= LONGEST_KEPT else _parse)(run) if _is_spelled(run) else [(run, 1)]
    return out


def count_syllables(text: str) -> int:
    """The sum of parts(), without making them; only short runs are remembered."""
    return sum([(_counted if len(run) <= LONGEST_KEPT else _count)(run) if "ก" <= run[0] <= "๎" and run != "ๆ" else 1 for run in _RUN.findall(text)])
