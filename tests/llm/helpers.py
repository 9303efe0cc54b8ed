"""A small table with every awkward case, and plain Python versions of what the operators promise."""

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, cls string, `key` int, row string, _kept int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(text or "")


def prose(seed, n):
    syllables = ["ba", "do", "ke", "lu", "mi", "no", "ra", "se", "ti", "vu", "za", "pe"]
    state, out = seed * 7919 + 17, []
    for _ in range(n):
        word = ""
        for _ in range(2 + state % 3):
            state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
            word += syllables[(state >> 33) % len(syllables)]
        out.append(word)
    return " ".join(out)


BASE = prose(1, 120)
NEAR = " ".join(w if k != 60 else "other" for k, w in enumerate(BASE.split()))
FAR = " ".join(BASE.split()[:60]) + " " + prose(2, 60)
TEXTS = [
    BASE, BASE.upper(), NEAR, FAR, None, "", " \t\n\x0b\x0c\r ", "one", "one two three", "ONE two\tthree", prose(3, 4), prose(4, 5),
    "😀 é ß́ \x1c x y", prose(5, 20_000), "a" * 100_000, "mail a@b.com_x@y.com or 1.2.3.4 and 999.1.1.1, card 4111 1111 1111 1111",
    "call +1 (499) 555-6503 or (499) 555-6503; x(at)foo(dot)org", "<|endoftext|>it's 's it'll", "12345 678 !!! ???", prose(6, 300), BASE,
]


def rows():
    out = [(k * 3, t, [None, "aa", "bb"][k % 3], [None, "s1", "s2", "s3", ""][k % 5]) for k, t in enumerate(TEXTS)]
    out += [(0, BASE, "aa", None), (0, BASE, "aa", None), (None, prose(7, 30), "bb", "s1"), (None, None, None, None), (-5, NEAR, None, "s2")]
    return [(i, t, lang, s, None, 0.5, 1, "c", 2, "r", 3) for i, t, lang, s in out]


def table(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, name, ids=range(0, 63, 3)):
    return spark.createDataFrame(
        [(i, int(i % 2 == 0), None) for i in ids] + [(0, 1, "x"), (None, 1, "y"), (6, None, "z"), (10**9, 0, "gone")],
        f"doc_id long, {name} int, extra string")


def shingles(text):
    w = words(lower(text))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def join_by_hand(data):
    """{row: (n_shingles, component_id, n_links)} by all pairs."""
    sets = [shingles(r[1]) for r in data]
    near = [[j for j in range(len(sets)) if j != i and sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])] for i in range(len(sets))]
    out = []
    for i in range(len(sets)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [data[j][0] for j in seen if data[j][0] is not None]
        out.append((data[i][0], len(sets[i]), min(ids) if ids else None, len(near[i])))
    return out


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card":
                pairs = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
                if not 13 <= len(digits) <= 19 or sum(d - 9 if d > 9 else d for d in pairs) % 10:
                    continue
            out.append((kind, m.start(), m.end()))
    return out


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(data):
    return zlib.crc32(data)
