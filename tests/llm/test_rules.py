import re
from collections import Counter

from sellerlens.llm import rules
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in rules.SYMBOLS for c in text), len(lines) - len(set(lines)), len(hit))


def test_measurements(spark):
    more = [(20, "a b c a b c"), (21, "a a a a a"), (22, "x\n y\nx\n\n\nx"), (23, "a b c d a b c x a b"), (24, "#1 $2 | <>"),
            (25, " ".join(["w"] * 5000)), (26, " ".join(str(i % 2500) for i in range(5000)))]
    docs = cases.documents(spark, more)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
                  for r in rules.ledger(docs).collect())
    assert got == Counter((d.doc_id, *brute(d.text)) for d in docs.collect())
    assert rules.ledger(cases.empty(spark)).count() == 0


def test_policies_and_ablation(spark):
    led = rules.ledger(cases.documents(spark, [(30, "the and of " * 40), (31, "# " * 80)])).cache()
    rows = led.select("doc_id", "failed", rules.apply_policy(led, "base").alias("base"), rules.apply_policy(led, "v2").alias("v2")).collect()
    for r in rows:
        assert r.base == (r.failed & 3 == 0) and r.v2 == (r.failed == 0)
    mask = rules.bits(rules.POLICIES["v2"])
    for r in rules.ablation(led, "v2").collect():
        bit = rules.bits([r.rule])
        assert r.failed == sum(bool(x.failed & bit) for x in rows)
        assert r.only == sum(x.failed & mask == bit for x in rows)


def test_stays_in_the_jvm(spark):
    plan = rules.ledger(cases.documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
