"""Alignment of tokenizers, personal data and periodic runs against brute force, and their defined cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pulsegrid.llm import crosstok, periods, private, queries

DOCS = "doc_id long, text string, start string, spans string, runs string, digest string, pair string, block string"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, *["x"] * 6) for i, t in zip(ids, texts, strict=True)], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tables(spark, tmp_path, texts, ids=None):
    frame(spark, texts, ids).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


ODD = [None, "", " ", "  ", "a ", "  a", "a  b", "a\n b", "a \n\n  b\t c", "a▁b", "<s> </s> <|endoftext|> <0x41>", "\x00 x", "é日本 ﬁ", "x" * 3000]


def aligned_brute(texts):
    a_of, b_of = (crosstok.default_paths()[k] for k in (0, 1))
    a_of, b_of = Tokenizer.from_file(a_of), sentencepiece.SentencePieceProcessor(model_file=b_of)
    a_of.encode_special_tokens = True
    signs = {s: bytes([b]) for b, s in enumerate(crosstok._SIGN)}
    counts, found = Counter(), []
    for text in texts:
        said = " " + (text or "")
        a = a_of.encode(said, add_special_tokens=False).ids if text else []
        b = b_of.encode(text) if text else []
        in_a = [b"".join(signs[s] for s in a_of.id_to_token(i)) for i in a]
        in_b = [bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(in_a) != said.encode() or b"".join(in_b) != said.encode():
            found.append(([], [], []))
            continue
        end_a, end_b = np.cumsum(list(map(len, in_a))).tolist(), np.cumsum(list(map(len, in_b))).tolist()
        both = sorted(set(end_a) & set(end_b))
        links = [(a[end_a.index(e)], b[end_b.index(e)]) for e in both]
        counts.update(links)
        groups, low = [], 0
        for e in both:
            groups.append("|".join(",".join(str(i) for i, x in zip(ids, ends, strict=True) if low < x <= e) for ids, ends in ((a, end_a), (b, end_b))))
            low = e
        found.append((a, b, [(links, ";".join(groups))]))
    best = Counter()
    for (x, y), n in counts.items():
        best[y] = max(best[y], n)
    rows = []
    for a, b, rest in found:
        if not rest:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links, groups = rest[0]
        rows.append((len(a), len(b), len(links), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), sha(groups)))
    return rows


def test_alignment_by_brute_force(spark, tmp_path):
    r = random.Random(4)
    words = ["the", "The", "house", "l'été", "12,5", "über", "--", "don't", "日本", "a\tb", "x\n"]
    texts = [" ".join(r.choices(words, k=r.randrange(1, 40))) for _ in range(40)]
    texts += ODD + ["the same house"] * 300 + ["the house " * 4000]
    ids = [None, None, *range(len(texts) - 4), 7, 7]
    want = aligned_brute(texts)
    got = queries.op11_tokenizer_alignment(spark, tables(spark, tmp_path, texts, ids)).collect()
    assert Counter(tuple(row) for row in got) == Counter((i, *row) for i, row in zip(ids, want, strict=True))
    assert queries.op11_tokenizer_alignment(spark, str(tmp_path)).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_segments_are_forgotten_and_blocks_small(spark, monkeypatch):
    pair = crosstok.Pair(*crosstok.default_paths(), memory=2000)
    rows = [pair.block(k, [b""] * 2, [f"word{k} here", f"the {k}"], np.ones(2, np.int64)).iloc[0] for k in range(40)]
    assert len(pair.at) < 20 and all(len(r.groups_sha256) == 2 for r in rows)
    texts = [f"some words {i} over and over {i % 3}" for i in range(60)] + ["a▁b"]
    want = sorted((i, *row) for i, row in enumerate(aligned_brute(texts)))
    monkeypatch.setattr(crosstok, "BLOCK", 50)
    assert sorted(map(tuple, crosstok.align(frame(spark, texts)).collect())) == want


def test_other_pieces_are_refused(monkeypatch):
    class Crossing(sentencepiece.SentencePieceProcessor):
        def id_to_piece(self, i):
            return "a▁b" if i == 500 else super().id_to_piece(i)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Crossing)
    with pytest.raises(ValueError, match="space behind another sign"):
        crosstok.Pair(*crosstok.default_paths())


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def private_brute(text):
    found = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            sums = [int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(digits[::-1])]
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(digits) <= 19 and sum(sums) % 10 == 0 or kind == "phone" and 8 <= len(digits) <= 15:
                found.append((kind, *m.span()))
    return found


def test_base_spans_by_brute_force(spark, tmp_path):
    r = random.Random(5)
    bits = [*"0123456789..  --++()@@ab_%éß١", "1.2.3.4", "4785380592391139", "+1 (743) 555-3824", "x@y.z", "255", "0001", "DE", "tel:"]
    texts = ["".join(r.choices(bits, k=r.randrange(0, 40))) for _ in range(4000)]
    texts += [None, "", "1." * 5000, "9" * 5000, "a@b.c" * 3000, "a@b.c@d.e", "999.1.2.3.4", "1.2.3.4.5.6.7.8.9", "+1 23456-", "word " * 30_000 + "me@there.org"]
    got = {row["doc_id"]: row for row in queries.op12_personal_data(spark, tables(spark, tmp_path, texts)).collect()}
    for i, text in enumerate(texts):
        want = private_brute(text)
        counts = Counter(k for k, _, _ in want)
        assert [got[i][f"n_{k}"] for k in BASE] == [counts[k] for k in BASE], text
        said = [f"{k}:{a}:{b}" for k, a, b in want]
        assert got[i]["base_sha256"] == sha(",".join(said)), text
        assert [s for s in got[i]["spans"].split(",") if s.split(":")[0] in BASE] == said


def test_added_spans():
    find = lambda text: [(k, text[a:b]) for k, a, b in private.find(text) if k not in private.BASE]
    assert find("pay GB82 WEST 1234 5698 7654 32, not GB83 WEST 1234 5698 7654 32") == [("account", "GB82 WEST 1234 5698 7654 32")]
    assert find("DE89370400440532013000 xDE89370400440532013000 DE893704004405320130001") == [("account", "DE89370400440532013000")]
    assert find("Account no: 12345678; account of 12345678; subaccount 1234567; acct#123") == [("account", "12345678")]
    assert find("see https://bob:s3cret@h.example.com/x and https://h.example.com/x") == [("address", "https://bob:s3cret@h.example.com")]
    assert find("tel:+1-555-123-4567, hotel:5551234567") == [("address", "tel:+1-555-123-4567")]
    assert find("josé@exámple.org josé@localhost jo@example.org") == [("intl_email", "josé@exámple.org")]
    assert private.redacted("mail jo@example.org, 1.2.3.4.") == "mail [email], [ip]."


def test_redaction_keeps_rows(spark):
    docs = frame(spark, ["me: jo@example.org", None, "clean", "clean"], [1, None, 3, 3])
    assert sorted(map(tuple, private.redact(docs).collect()), key=repr) == sorted([(1, "me: [email]"), (None, None), (3, "clean"), (3, "clean")], key=repr)


def runs_brute(w, least):
    runs = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i >= q:
                runs.setdefault((i, j + q), q)
            i = max(j, i + 1)
    found = sorted(((s, e - s, q) for (s, e), q in runs.items() if e - s >= max(least, 2 * q)), key=lambda r: (r[0], r[2]))
    dropped = {k for s, n, q in found for k in range(s + q, s + n)}
    return found, " ".join(x for k, x in enumerate(w) if k not in dropped)


def test_runs_by_brute_force():
    r = random.Random(6)

    def text():
        w = [r.choice("abcdef"[: r.choice([1, 2, 3, 5])]) for _ in range(r.randrange(60))]
        return w + r.choices("abc", k=r.randrange(1, 8)) * r.randrange(7) + w[:3] if r.random() < 0.6 else w

    for _ in range(60):
        texts = [text() for _ in range(r.randrange(1, 30))]
        got = periods.slice_runs(list(range(len(texts))), texts, 12)
        for k, w in enumerate(texts):
            assert ([tuple(x.values()) for x in got.runs[k]], got.collapsed[k]) == runs_brute(w, 12), w


def test_periodic_runs_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(periods, "SLICE", 3000)
    r = random.Random(7)
    texts = [" ".join(r.choices(["a", "b", "c\td", "é\n", "ee"], k=r.randrange(1, 80))) for _ in range(150)]
    texts += [None, "", " \n", "one", "x " * 20_000, "the cat sat " * 3000 + "end", "日本 語 " * 8]
    ids = [*range(len(texts) - 2), 7, None]
    got = Counter(tuple(row) for row in queries.op13_periodic_runs(spark, tables(spark, tmp_path, texts, ids)).collect())
    want = Counter()
    for i, t in zip(ids, texts, strict=True):
        w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
        if i is not None and w and (h := zlib.crc32(str(i).encode())) % 10 == 0:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs, collapsed = runs_brute(w, 12) if len(w) < 1000 else ([(0, len(w) - (w[-1] == "end"), 1 if w[0] == "x" else 3)], " ".join(w[:1] if w[0] == "x" else [*w[:3], "end"]))
        s, n, q = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        want[i, len(runs), s, n, q, n and 1000 * n // q, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed)] += 1
    assert got == want


def test_new_operators_on_an_empty_table(spark, tmp_path):
    folder = tables(spark, tmp_path, [])
    for name in ("op11_tokenizer_alignment", "op12_personal_data", "op13_periodic_runs"):
        assert queries.queries()[name](spark, folder).collect() == []
