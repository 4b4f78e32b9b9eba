"""Plain versions of the operators' results, and the tables that tests run on."""

import hashlib
import random
import re

WORD = re.compile("[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus():
    """(doc_id, text): copies, near copies, shared passages and lines, nulls, empty, long and odd texts."""
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(400)]
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, base, long_line = prose(60), prose(120), prose(70)
    docs = [" ".join(base), " ".join(base), " ".join(base).upper()]
    for i in range(12):
        words = list(base)
        for _ in range(i % 5):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        docs.append(" ".join(words))
    docs += [" ".join(prose(30) + passage + prose(20)) for _ in range(8)]
    for i in range(8):
        words = list(long_line)
        words[i * 3] = "changed"
        docs.append("Shared header line here\n" + " ".join(words) + "\n" + " ".join(prose(25)))
    docs += ["", None, " \t\n\x0b ", "word", "two words", "a " * 700, "x" * 5000, "tab\tand\x0bmore\x0clines\r\nnext  one ", "é日本 \U0001f600 İstanbul Σίσυφος don't we'll I'M 12³", "<|endoftext|> a<|endoftext|>b\0c"]
    docs += [" ".join(prose(20_000)), "Licensed under the MIT License.\nAll rights reserved.", "This work is licensed under the GNU General Public License, version 3. Other words"]
    return list(enumerate(docs))


def documents(spark, rows=None):
    """The corpus as a table with a null id, a repeated row, and further columns whose names operators use inside."""
    rows = corpus() + [(None, "no id at all"), (3, corpus()[3][1])] if rows is None else rows
    names = ["d", "t", "h", "u", "v", "w", "id", "key", "row", "part", "words", "ids", "n", "rep", "cluster", "new_text", "lns", "few"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{x}` string" for x in names)
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t), *names) for i, t in rows], schema)


def words(text):
    return WORD.findall(text or "")


def repeats(docs, window=20):
    """doc_id: (words, removed, digest of what is left)."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            gram = tuple(w[s : s + window])
            if gram in seen:
                gone[s : s + window] = [True] * window
            seen.add(gram)
        out[i] = len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()
    return out


def shingles(text, k):
    w = words((text or "").translate(UPPER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def groups(docs, k=3, num=85, den=100):
    """doc_id: (set size, least reachable id)."""
    sets = {i: shingles(t, k) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def line_removals(docs):
    """doc_id: numbers of the lines that an earlier line matches."""
    earlier, out = [], {}
    for i, t in sorted(docs):
        out[i] = set()
        for n, line in enumerate(t.split("\n")) if t is not None else ():
            s = frozenset(words(line))
            if s:
                if any(5 * len(s & o) >= 4 * len(s | o) for o in earlier):
                    out[i].add(n)
                earlier.append(s)
    return out
