from codeloom.llm import preferences as p

TURNS = "conv_id long, turn long, role string, text string"


def test_prefix_masks_and_rendering(spark):
    turns = lambda *x: [{"role": r, "text": t} for r, t in x]
    shared = [("system", "s"), ("user", "hi")]
    rows = [
        (1, turns(*shared, ("assistant", "good")), turns(*shared, ("assistant", "bad"), ("user", "hm"))), (2, turns(("user", "a")), turns(("user", "a"))),
        (3, None, turns(("assistant", "x"))), (4, turns(("user", "a")), turns(("user", "b"))),
    ]
    df = spark.createDataFrame(rows, "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    got = {r["pair_id"]: r for r in p.pair_up(df).collect()}
    assert [got[i]["prefix_turns"] for i in (1, 2, 3, 4)] == [2, 1, 0, 0]
    r = got[1]
    assert r["prompt"] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"
    for side, text in (("chosen", "good"), ("rejected", "bad")):
        ((start, length),) = [(m["start"], m["length"]) for m in r[f"{side}_mask"]]
        assert r[side][start : start + length] == text + "<|im_end|>\n"
    assert (got[2]["chosen"], got[2]["rejected"], got[3]["chosen"]) == ("", "", "")


def test_against_other_answers(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c}-{t}") for c in range(20) for t in range(2 + c % 3)] + [(99, 0, None, None)]
    convs = p.conversations(spark.createDataFrame(rows, TURNS))
    pairs = {r["pair_id"]: r for r in p.against_other_answers(convs).collect()}
    assert sorted(pairs) == list(range(20))
    for i, r in pairs.items():
        last = max(k for k, t in enumerate(r["chosen"]) if t["role"] == "assistant")
        assert r["rejected"][:last] == r["chosen"][:last] and len(r["rejected"]) == last + 1
        assert not r["rejected"][last]["text"].startswith(f"{i}-")
    assert p.against_other_answers(convs.limit(0)).count() == 0


def test_pairs_by_id_with_a_missing_conversation(spark):
    convs = p.conversations(spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "b")], TURNS))
    chosen = spark.createDataFrame([(7, 1, 2), (8, 1, 5)], "pair_id long, chosen_id long, rejected_id long")
    got = {r["pair_id"]: r for r in p.pair_up(p.pairs_of(convs, chosen)).collect()}
    assert "b" in got[7]["rejected"] and got[8]["rejected"] == ""


def test_the_rejected_answer_differs_from_the_chosen_one(spark):
    # Nine in ten answer alike; conversation 50 has no answer, and a table of equal answers has no pair.
    rows = [(c, t, ("user", "assistant")[t], "same" if t and c % 10 else f"{c}-{t}") for c in range(50) for t in (0, 1)] + [(50, 0, "user", "hi")]
    turns = spark.createDataFrame(rows, TURNS).withColumn("id", p.F.lit(1)).withColumn("turns", p.F.lit("x"))
    got = {r["pair_id"]: r for r in p.pair_up(p.against_other_answers(p.conversations(turns), every=True)).collect()}
    assert sorted(got) == list(range(51)) and got[50]["status"] == "no assistant turn" and got[50]["chosen"] == ""
    for c in range(50):
        assert got[c]["status"] == "pair" and got[c]["chosen"] != got[c]["rejected"] and f"{c}-0" in got[c]["prompt"]
    alike = p.conversations(turns.where("conv_id % 10 <> 0 and conv_id < 50"))
    assert p.against_other_answers(alike).count() == 0
    assert {r["status"] for r in p.against_other_answers(alike, every=True).collect()} == {"no other answer"}


def brute_pair(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    show = lambda turns: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)

    def mask(turns):
        out, at = [], 0
        for r, t in turns:
            head, body = len(f"<|im_start|>{r}\n"), len(t) + len("<|im_end|>\n")
            out += [(at + head, body)] if r == "assistant" else []
            at += head + body
        return out

    return n, show(chosen[:n]), show(chosen[n:]), show(rejected[n:]), mask(chosen[n:]), mask(rejected[n:])


def test_pairs_against_brute_force(spark):
    import random

    r = random.Random(5)
    turn = lambda: (r.choice(["user", "assistant", "system", "é"]), r.choice(["a", "b", "", "ü\n" * 3, "x" * 9000]))
    pairs = []
    for i in range(120):
        shared = [turn() for _ in range(r.randrange(4))]
        pairs.append((i, *(shared + [turn() for _ in range(r.randrange(4))] for _ in range(2))))
    kind = "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"
    got = {x["pair_id"]: x for x in p.pair_up(spark.createDataFrame(pairs, kind)).collect()}
    for i, chosen, rejected in pairs:
        x = got[i]
        masks = [[(m["start"], m["length"]) for m in x[c]] for c in ("chosen_mask", "rejected_mask")]
        assert (x["prefix_turns"], x["prompt"], x["chosen"], x["rejected"], *masks) == brute_pair(chosen, rejected)
