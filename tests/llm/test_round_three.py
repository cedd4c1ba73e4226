"""Conversation repair, the filter audit and the quality rules against plain Python."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import conversation_repair as cr
from quern.llm import filter_audit, quality_rules
from quern.llm.words import text_slices

SPACE = "\t\n\x0b\x0c\r "

# --- 11: conversation repair


def cheapest(codes):
    """(cost, audit) by a search over (row, whose turn is next), knowing nothing of charts."""
    done, agenda = {}, [(0, "", 0, "start")]
    while agenda:
        cost, audit, at, state = heapq.heappop(agenda)
        if (at, state) in done:
            continue
        done[at, state] = (cost, audit)
        allowed = {"start": "su", "s": "u", "u": "a", "a": "u"}[state]
        for role in allowed:
            if role in "ua":
                heapq.heappush(agenda, (cost + 2, audit + "I", at, role))
            if at < len(codes) and codes[at] & 3 not in (cr.BLANK, cr.DUPLICATE):
                more = codes[at] & 3 == cr.TRUNCATED
                if "sua?"[codes[at] >> 2] == role:
                    heapq.heappush(agenda, (cost + more, audit + "K", at + 1, role))
                elif role in "ua":
                    heapq.heappush(agenda, (cost + 2 + more, audit + "R", at + 1, role))
        if at < len(codes):
            heapq.heappush(agenda, (cost + 3, audit + "D", at + 1, state))
    return min(done[len(codes), s] for s in ("start", "a") if (len(codes), s) in done)


def test_charts_find_the_cheapest_repair():
    rng = random.Random(1)
    for n in [0, 1, 1, 2, 2, 3, 3, 3, *[rng.randrange(4, 14) for _ in range(400)]]:
        codes = bytes(rng.randrange(16) for _ in range(n))
        assert cr.repair(codes) == cheapest(codes), list(codes)


def test_pieces_of_a_conversation_join_to_its_chart():
    rng = random.Random(2)
    for n in (300, 700, 2_000):
        codes = bytes(rng.choice([0, 4, 4, 8, 8, 12, 5, 9, 6, 7, 11]) for _ in range(n))
        whole = cheapest(codes)
        assert cr.repair(codes) == whole
        column, at = cr.moves(b"", [cr.START])[cr.START], 0
        while at < n:
            step = rng.randrange(1, 400)
            column = cr.joined(column, cr.moves(codes[at : at + step], list(column)))
            at += step
        assert min(column[i] for i in cr._DONE if i in column) == whole


def repaired(rows):
    """Every column of the query for one conversation's rows after damage, as (turn, role, text)."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, codes, counts = set(), [], Counter()
    for _, role, text in rows:
        bare = text.strip(SPACE)
        fault = cr.BLANK if not bare else cr.DUPLICATE if (role, text) in seen else cr.FINE if bare[-1] in ".!?" else cr.TRUNCATED
        seen.add((role, text))
        counts[fault] += 1
        codes.append("sua".find(role[:1]) * 4 + fault if role[:1] and role[:1] in "sua" else 12 + fault)
    cost, audit = cheapest(codes)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    lines, at, last = [], 0, ""
    for letter in audit:
        new = "assistant" if last == "u" else "user"
        if letter != "I":
            _, role, text = rows[at]
            at += 1
        if letter != "D":
            role, text = (new, "") if letter == "I" else (new, text) if letter == "R" else (role, text)
            lines.append(f"{role}:{text}")
            last = role[0]
    return gaps, counts[cr.BLANK], counts[cr.DUPLICATE], counts[cr.TRUNCATED], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def result(spark, rows):
    schema = "conv_id long, turn long, role string, text string, place long, code string, digest string, first int, kind int, _n int, sha int"
    df = spark.createDataFrame([(*r, 1, "c", "d", 1, 2, 3, 4) for r in rows], schema).repartition(3)
    fixed = cr.repair_conversations(df)
    shas = {r["conv_id"]: r["sha"] for r in cr.message_digests(fixed.messages).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r["conv_id"]: (*[r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")], shas.get(r["conv_id"], empty)) for r in fixed.conversations.collect()}


def test_repair_of_odd_and_of_long_conversations(spark):
    rng = random.Random(3)
    roles, texts = ["system", "user", "assistant", "tool", "", None, "User", "unknown"], ["Yes.", "Yes.", "No", " ", None, "", "What?\n", "a\tb!", "Ünï…", "x" * 20_000]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(300)]
    rows += [(100, None, "user", "Hi.")] * 5 + [(101, 3, "tool", None)] + [(102, 2**40, "system", "S.")]
    # one conversation of most rows, in several ranges, with repeats far apart
    rows += [(50, t, rng.choice(["user", "assistant"]) if rng.random() < 0.1 else ["user", "assistant"][t % 2], f"Turn {t % 2500}{rng.choice(['.', '.', '.', ''])}") for t in range(3_000)]
    by_conv = {}
    for c, *row in rows:
        by_conv.setdefault(c, []).append(tuple(row))
    got = result(spark, rows)
    assert set(got) == set(by_conv)
    for c, own in by_conv.items():
        assert got[c] == repaired(own), c


def test_repair_of_no_rows_and_of_damaged_ones(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    assert cr.repair_conversations(spark.createDataFrame([], schema)).conversations.count() == 0
    rows = [(c, t, ["user", "assistant"][t % 2], f"Text {c} {t}. And more!") for c in range(60) for t in range(4)] + [(None, None, None, None), (7, None, "user", None)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "conversations.parquet"))
    by_conv = {}
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        own = by_conv.setdefault(c, [])
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    got = {r["conv_id"]: tuple(r)[1:] for r in cr.op11_earley_repair(spark, str(tmp_path)).collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: repaired(own) if own else nothing for c, own in by_conv.items()}


# --- 12: filter audit


def audited(docs, labels):
    """Rows of the audit, from every order by itself; docs are (doc_id, text, source)."""
    words = lambda t: [w for w in re.split(f"[{SPACE}]+", t) if w]
    good, toxic = ({d for d, *marks in labels if d is not None and marks[i] == 1} for i in (0, 1))
    judged = []
    for doc_id, text, source in docs:
        text = text or ""
        w = words(text)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in docs),
        }
        judged.append((source or "", fails, doc_id in good, doc_id in toxic))
    out = []
    for part in {j[0] for j in judged}:
        own, rows = [j for j in judged if j[0] == part], []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                lost = [j for j in left if j[1][f]]
                left = [j for j in left if not j[1][f]]
                fails = sum(j[1][f] for j in own)
                unique = sum(j[1][f] and sum(j[1].values()) == 1 for j in own)
                rows.append([part, "".join(order), step, len(left), len(lost), fails - len(lost), unique, sum(j[2] for j in lost), sum(j[3] for j in lost)])
        shapley = Counter()
        for r in rows:
            shapley[r[1][r[2] - 1]] += r[4]
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def test_audit_is_that_of_every_order(spark):
    rng = random.Random(4)
    texts = [None, "", " \n", "A" * 9, *[" ".join(rng.choice(["word", "Big", "$", "x", f"w{i}", f"v{j}", f"u{i * j}"]) for j in range(rng.choice([5, 60, 200]))) for i in range(40)], "w " * 40_000]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice([None, "", "s", "s", "t"])) for _ in range(150)] + [(7, "", "only"), (7, "", "only")]
    labels = [(i, rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for i in range(50)] + [(3, 1, 1), (None, 1, 1)]
    df = spark.createDataFrame([(*d, "p", 1, True, False) for d in docs], "doc_id long, text string, source string, part string, n int, good boolean, A boolean")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    judged = filter_audit.verdicts(df, marks, filter_audit.rules(F.coalesce("text", F.lit(""))))
    got = sorted(tuple(r) for r in filter_audit.audit(judged).collect())
    assert got == audited(docs, labels)
    none = filter_audit.verdicts(df.limit(0), marks, filter_audit.rules(F.col("text")))
    assert filter_audit.audit(none).count() == 0


def test_audit_of_other_filters(spark):
    df = spark.range(12).select(F.lit("p").alias("part"), *[(F.col("id") % k == 0).alias(f"f{k}") for k in (2, 3)], F.lit(True).alias("good"), F.lit(False).alias("toxic"))
    df = df.withColumnsRenamed({"f2": "X", "f3": "Y"})
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in filter_audit.audit(df, ("X", "Y")).collect()}
    assert got == {("XY", 1): (6, 6, 0, 4, 10), ("XY", 2): (4, 2, 2, 2, 6), ("YX", 1): (8, 4, 0, 2, 6), ("YX", 2): (4, 4, 2, 4, 10)}


# --- 13: quality rules


def counted(text):
    w = re.findall(f"[^{SPACE}]+", text)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    covered = {i + j for i, x in enumerate(windows) if often[x] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics_are_the_plain_counts():
    rng = random.Random(5)
    texts = ["", " ", "\n\n", "a", "a b c d e a b c d e", "é " * 9, "x\nx\n\x0b\nX\nx ", "#*$%&|<> é#", "a b c d a b c d a b c d", "    x"]
    texts += ["".join(rng.choice(["a", "b ", "c\n", " ", "é", "#", "a b c d e ", "\r\n", "\t"]) for _ in range(rng.randrange(1, 400))) for _ in range(300)] + ["long " * 60_000]
    got = []
    for _, data, offs in text_slices(pa.array(texts), 2_000):
        got += [tuple(int(x) for x in c) for c in quality_rules.statistics(data, offs)[0]]
    assert got == [counted(t) for t in texts]


def test_trees_learn_and_never_rise_where_they_may_not():
    rng = np.random.default_rng(6)
    x = rng.random((4_000, len(quality_rules.FEATURES)))
    j, k = quality_rules.FEATURES.index("symbols"), quality_rules.FEATURES.index("capitals")
    y = ((x[:, j] < 0.5) & (x[:, k] > 0.3)).astype(float)
    y[rng.random(4_000) < 0.1] = 1  # noise that would make the score rise
    y[x[:, j] > 0.9] = 1
    forest = quality_rules.fit(x[:3_000], y[:3_000])
    free = quality_rules.fit(x[:3_000], y[:3_000], falling=())
    for name in quality_rules.FALLING:
        f = quality_rules.FEATURES.index(name)
        grid = np.repeat(x[:200], 21, 0)
        grid[:, f] = np.tile(np.linspace(-0.1, 1.1, 21), 200)
        assert (np.diff(quality_rules.chances(forest, grid).reshape(200, 21), axis=1) <= 1e-12).all()
    rises = np.repeat(x[:200], 21, 0)
    rises[:, j] = np.tile(np.linspace(0, 1, 21), 200)
    assert (np.diff(quality_rules.chances(free, rises).reshape(200, 21), axis=1) > 0).any()
    assert ((quality_rules.chances(free, x[3_000:]) > 0.5) == y[3_000:]).mean() > 0.88

    def walked(row):  # a node at a time
        total = 0.0
        for node in forest.roots:
            while forest.feature[node] >= 0:
                node = forest.left[node] + (row[forest.feature[node]] > forest.cut[node])
            total += forest.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(quality_rules.chances(forest, x[:50]), [walked(r) for r in x[:50]])
    assert (quality_rules.chances(quality_rules.fit(np.zeros((0, len(quality_rules.FEATURES))), np.zeros(0)), x[:3]) == 0.5).all()


def test_rules_of_odd_documents(spark):
    texts = [None, "", "One two three.", "a b c d e " * 9, "This is a text of ten words and some more, all plain.", "x" * 100_000, "w " * 30_000]
    df = spark.createDataFrame([(i % 5 if i else None, t, 1, 2, True) for i, t in enumerate(texts)], "doc_id long, text string, key int, score int, kept boolean")
    forest = quality_rules.train(df, spark.createDataFrame([], "doc_id long, quality int"))
    rows = quality_rules.judge(df, forest).collect()
    assert sorted(tuple(r[c] for c in quality_rules.COUNTS) for r in rows) == sorted(counted(t or "") for t in texts)
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and r["kept"] == (not r["base_failed"]) for r in rows)
    assert quality_rules.judge(df.limit(0), forest).count() == 0


def test_trees_tell_held_out_quality(spark):
    """Trained without the held-out fifth of sf0.1's labels: its bad documents go, and the good ones that pass the base rules stay."""
    sf = "/root/testdata/sf0.1"
    told = quality_rules.op13_monotone_trees(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where(quality_rules.held_out())
    rows = told.select("quality", "base_failed", "kept").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert len(good) > 500 and np.mean(good) > 0.995 and np.mean(bad) < 0.01
