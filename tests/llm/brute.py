"""Awkward tables, and plain-Python versions of what the operators compute."""

import hashlib
import random
import re

from parcelon.llm.common import shared_dir

#: Columns beyond those of documents, under names that the operators use themselves.
CLASHES = ["id", "row", "row_", "h", "b", "k", "g", "node", "owner", "spans", "score", "secrets", "kept", "key", "sha", "digest", "part", "file", "start", "bucket", "block", "size", "order", "name"]
LOW, HIGH = -(1 << 63), (1 << 63) - 1
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega north south east west river garden house street winter summer tiger dragon monkey letter".split()


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def documents(seed=1, n=220):
    """(doc_id, text): copies, near copies, shared passages, nulls, ties, repeated rows and ids, long texts."""
    r = random.Random(seed)
    base = [sentence(r, r.randint(60, 140)) for _ in range(12)]
    passage = sentence(r, 14)
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.2:
            text = r.choice(base)
        elif kind < 0.55:  # near copies of all degrees
            words = r.choice(base).split()
            for _ in range(r.randint(0, 9)):
                words[r.randrange(len(words))] = r.choice(WORDS)
            text = " ".join(words)
        elif kind < 0.7:
            text = sentence(r, r.randint(3, 30)) + ". " + passage + ". " + sentence(r, r.randint(1, 20))
        else:
            text = sentence(r, r.randint(1, 90))
        if r.random() < 0.2:
            text = text.title() if r.random() < 0.5 else text.upper()
        rows.append((i * 3 - 60, text))
    rows += [(None, None), (None, ""), (None, base[0]), (None, "only here and nowhere else at all"), (7001, None), (7002, ""), (7003, " \t\n "), (LOW, base[1]), (HIGH, base[1]), (HIGH - 1, "one word")]
    rows += [(7004, "a b"), (7005, "A  B"), (7006, "Ünïcode Ärger STRASSE straße 🎉 é " * 3), (7007, "x\x00y \x01 \x02!! b\x02 \x02"), (7008, "see <|endoftext|> there")]
    rows += [(7010, base[2])] * 3 + [(7011, base[3]), (7011, base[4]), (7011, "other text of the same id"), (7012, base[3] + " x")]
    rows += [(7013, sentence(random.Random(9), 9000)), (7014, sentence(random.Random(9), 9000) + " end"), (7015, "é" * 300), (7016, "é" * 299)]
    rows += [(None, base[5])] * 4
    return rows


def write(spark, rows, labels=(), extra=True):
    """A folder with documents (and labels) as the queries read them."""
    folder = shared_dir(spark)
    full = [(k, t, "en", "s", None if t is None else len(t), *([i % 3] * len(CLASHES) if extra else [])) for i, (k, t) in enumerate(rows)]
    names = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} long" for c in CLASHES if extra)
    spark.createDataFrame(full, names).repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, y) for k, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def ascii_lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))


def shingles(text):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def groups(rows):
    """For each row the number of its component under the links of equal or near sets."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(rows))], sets


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def removed(rows, span=50):
    """For each row its bytes and which of them repeat from a smaller id."""
    first = {}
    raw = [(t or "").encode() for _, t in rows]
    for (k, _), data in zip(rows, raw):
        if k is not None:
            for i in range(len(data) - span + 1):
                w = data[i : i + span]
                first[w] = min(first.get(w, k), k)
    for (k, _), data in zip(rows, raw):
        gone = bytearray(len(data))
        if k is not None:
            for i in range(len(data) - span + 1):
                if first[data[i : i + span]] < k:
                    gone[i : i + span] = b"\1" * span
        yield data, gone
