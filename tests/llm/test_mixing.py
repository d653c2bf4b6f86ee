import random
import re

from riskloom.llm.mixing import LEVELS, leaf_budgets, mix_sources

WEIGHTS = {"domain": {"x": 3, "y": 1}, "lang": {"en": 5}, "source": {"s0": 2, "s1": 4}}


def pour(budget, children):
    """children: name -> (weight, capacity); shortages go to the siblings that can take more."""
    out, open_ = dict.fromkeys(children, 0.0), set(children)
    while open_ and budget > 1e-9:
        weight = sum(children[c][0] for c in open_)
        full = {c for c in open_ if children[c][1] <= budget * children[c][0] / weight + 1e-12}
        if not full:
            for c in open_:
                out[c] = budget * children[c][0] / weight
            return out
        for c in full:
            out[c] = children[c][1]
            budget -= children[c][1]
        open_ -= full
    return out


def brute_budgets(leaves, tokens, epochs):
    def down(prefix, budget):
        level = len(prefix)
        if level == 3:
            return {prefix: budget}
        names = sorted({k[level] for k in leaves if k[:level] == prefix})
        nodes = {n: (WEIGHTS[LEVELS[level]].get(n, 1), epochs * sum(v for k, v in leaves.items() if k[:level + 1] == (*prefix, n))) for n in names}
        found = {}
        for n, b in pour(budget, nodes).items():
            found |= down((*prefix, n), b)
        return found
    return down((), tokens)


def test_budgets_against_brute_force(spark):
    r = random.Random(2)
    for _ in range(4):
        leaves = {(d, lang, f"s{i}"): r.choice([1, 10, 200, 5000]) for d in "xyz" for lang in ("en", "de") for i in range(3) if r.random() < 0.8}
        total = sum(leaves.values())
        for share in (0.1, 0.7, 1.9, 5):
            rows = leaf_budgets(spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, source string, tokens long"),
                                float(int(total * share)), WEIGHTS, 2).collect()
            want = brute_budgets(leaves, int(total * share), 2)
            assert all(abs(x.budget - want[x.domain, x.lang, x.source]) <= 1.0 for x in rows) and len(rows) == len(want)


def test_selection_fills_every_budget_with_whole_epochs_and_a_prefix(spark):
    r = random.Random(3)
    docs = [(i, " ".join(f"w{j}" for j in range(r.randint(0, 40))), r.choice(["en", "de", None]), f"s{r.randint(0, 3)}") for i in range(400)]
    docs += [(None, None, None, None), (None, "a b c", None, None), (None, "a b c", None, None), (7, "", "en", "s0"), (900, "k " * 20_000, "en", "s1"),
             (901, "q r s", "en", "s2"), (901, "q r s", "en", "s2")]
    df = spark.createDataFrame([(*d, 9, "clash") for d in docs], "doc_id long, text string, lang string, source string, n_tokens int, domain string").repartition(4)
    for share in (0.3, 2.5):
        rows = mix_sources(df, share=share, epochs=3, range_rows=20, with_text=True).collect()
        words = {}
        for i, t, lang, s in docs:
            words.setdefault((lang or "", s or ""), 0)
            words[lang or "", s or ""] += len(re.findall(r"\S+", t or ""))
        total = sum(words.values())
        assert abs(sum(x.take_tokens for x in rows) - int(total * share)) <= len(words)
        for x in rows:
            assert 1 <= x.take_tokens <= x.n_tokens and len(x.text.split()) == x.take_tokens
        for key in words:
            last = {}
            for x in rows:
                if (x.lang, x.source) == key:
                    last.setdefault(x.epoch, []).append(x)
            whole = [sum(x.take_tokens for x in v) for e, v in sorted(last.items())][:-1]
            assert all(n == words[key] for n in whole)
            assert sum(x.take_tokens < x.n_tokens for v in last.values() for x in v) <= 1      # one cut document
    one = sorted(map(str, mix_sources(df, share=0.3).collect()))
    assert one == sorted(map(str, mix_sources(df.repartition(7), share=0.3, range_rows=3).collect()))


def test_empty_table(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0
