"""Message templates against a plain clustering, small leaves and hot ones."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.logtext import VARIABLE_PARTS
from pulsegrid.operators import logs, templates


def brute_leaders(messages, similarity=0.5, lead_words=1):
    """Leader of every form: forms by count and text, each to the first leader that agrees in enough positions."""
    counts = Counter(re.sub(VARIABLE_PARTS, "<*>", m) for m in messages)
    leaders, out = [], {}
    for form in sorted(counts, key=lambda f: (counts[f], f), reverse=True):
        words = form.split()
        for lead in leaders:
            other = lead.split()
            if len(other) == len(words) and other[:lead_words] == words[:lead_words] and sum(map(str.__eq__, words, other)) >= similarity * len(words):
                out[form] = lead
                break
        else:
            leaders.append(form)
            out[form] = form
    return out, counts


def brute_templates(messages):
    leader, counts = brute_leaders(messages)
    out = Counter()
    for lead in set(leader.values()):
        members = [f for f in leader if leader[f] == lead]
        template = " ".join(a[0] if len(set(a)) == 1 else "<*>" for a in zip(*[f.split() for f in members]))
        out[template] += sum(counts[f] for f in members)
    return out


def test_templates_equal_brute_force(spark):
    messages = [f"user {n} logged in from {h}" for n in "abcdefg" for h in ("paris", "rome")] * 2
    messages += [f"disk {i} is full" for i in range(9)] + ["disk cache was cleared", "user gone", "job x done", "job y failed"]
    df = spark.createDataFrame([(m,) for m in messages], "message string")
    mined = templates.mine_templates(df)
    got = {r["template"]: r["n"] for r in mined.groupBy("template").agg(F.sum("n").alias("n")).collect()}
    assert got == brute_templates(messages)
    assert logs.with_template(df, mined).where("template is null").count() == 0


@pytest.mark.parametrize(("similarity", "lead_words", "leaf_forms"), [(0.5, 1, 20_000), (0.5, 1, 40), (0.7, 1, 25), (0.34, 2, 60), (0.0, 1, 50), (1.0, 1, 50)])
def test_random_forms_equal_brute_force(spark, similarity, lead_words, leaf_forms):
    """One hot leaf of forms over few words, so that many agree by halves, and some small ones."""
    rng = random.Random(leaf_forms)
    messages = ["get " + " ".join(rng.choice("abcdef") for _ in range(7)) for _ in range(300)]
    messages += [rng.choice("xyz") + " " + " ".join(rng.choice("abcdefghijklmnop") for _ in range(3)) for _ in range(150)] + ["", "one"]
    df = spark.createDataFrame([(m,) for m in messages], "message string")
    mined = templates.mine_templates(df, similarity=similarity, lead_words=lead_words, leaf_forms=leaf_forms)
    want, counts = brute_leaders([m for m in messages if m], similarity, lead_words)
    assert {r.form: r.leader for r in mined.collect()} == want
    assert {r.form: r.n for r in mined.collect()} == counts


def test_unlike_forms_take_few_jobs(spark, monkeypatch):
    """10,000 forms of one leaf, each its own leader: written tables do not grow with leaders."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(6))
    forms = {"event " + " ".join(word() for _ in range(8)) for _ in range(10_000)}
    df = spark.createDataFrame([(m,) for m in forms], "message string")
    written = []
    monkeypatch.setattr(templates, "durable", lambda df, name="cut", real=templates.durable: written.append(name) or real(df, name))
    mined = templates.mine_templates(df)
    assert mined.select("leader").distinct().count() == len(forms)
    assert written == ["forms", "grouped"]


def test_no_messages(spark):
    assert templates.mine_templates(spark.createDataFrame([], "message string")).count() == 0
