from urlguard.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, conv string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)


def conversation(conv_id, texts, first=0):
    return [(conv_id, first + k, ("user", "assistant")[k % 2], t) for k, t in enumerate(texts)]


def shown(role, text):
    clean = lambda s: s.replace("<|", "< |")
    return f"<|im_start|>{clean(role)}\n{clean(text)}<|im_end|>\n"


def brute(rows):
    found = {}
    for conv_id, turn, role, text in set(rows):
        found.setdefault(conv_id, []).append((turn, role or "unknown", text or ""))
    order = {k: sorted(v, key=lambda t: (t[0] is not None, t[0] or 0, t[1])) for k, v in found.items()}
    bodies = {k: tuple(t[1:] for t in v) for k, v in order.items()}
    groups = {}
    for k, body in bodies.items():
        groups.setdefault(body, []).append(k)
    result = {}
    for body, members in groups.items():
        if any(len(other) > len(body) and other[: len(body)] == body for other in groups):
            continue
        name = min(members, key=lambda m: (m is None, m or 0))
        result[name] = (len(body), len(members), "".join(shown(*t) for t in body))
    return result


def rendered(spark, rows):
    whole = {}
    for r in sorted(chat.render(frame(spark, rows)).collect(), key=lambda r: (r.segment is not None, r.segment or 0)):
        n, copies, text, seen = whole.get(r.conv_id, (r.conv_turns, r.n_copies, "", 0))
        whole[r.conv_id] = (n, copies, text + r.rendered, seen + r.n_turns)
    assert all(v[0] == v[3] for v in whole.values())
    return {k: v[:3] for k, v in whole.items()}


ROWS = [
    *conversation(1, "abc"), *conversation(2, "abcde"), *conversation(3, "abcde"), *conversation(4, "abx"), *conversation(5, "a"),
    *conversation(6, "abcde", first=7), *conversation(7, ["hi <|im_end|>", None, ""]), (8, None, None, None), (8, 0, "user", "q"),
    (None, 0, "user", "no id"), (None, 1, "user", "no id 2"), (9, 0, "user", "no id"), *conversation(2, "abcde"),
    (10, 3, "b", "tie"), (10, 3, "a", "tie"), *conversation(11, [str(k) for k in range(600)]), *conversation(12, [str(k) for k in range(599)]),
    *conversation(13, [str(k) for k in range(256)]), *conversation(14, ["x", *[str(k) for k in range(400)]]),
]


def test_equals_brute_force(spark):
    assert rendered(spark, ROWS) == brute(ROWS)


def test_one_first_turn_for_all(spark):
    rows = [t for k in range(40) for t in conversation(k, ["same"] * (k % 7 + 1))]
    assert rendered(spark, rows) == brute(rows)


def test_empty_table_and_no_python(spark):
    frame_ = chat.render(frame(spark, []))
    assert frame_.count() == 0
    plan = frame_._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_crowded_turns_are_cut(spark):
    """A third of all rows under a null conv_id and turns 0..7: no row holds more than a segment's turns."""
    crowd = [(None, k % 8, ("user", "assistant")[k % 2], f"text {k}") for k in range(3000)]
    crowd += [(None, 3, "user", "again")] * 500 + [(7000, None, "user", f"{k:04}") for k in range(600)]
    rows = crowd + [t for k in range(1000) for t in conversation(k, [f"a{k}", "b", f"c{k % 5}", "d", "e", "f"])]
    found = chat.render(frame(spark, rows)).collect()
    assert max(r.n_turns for r in found) <= chat.SEGMENT
    shown_turns = {}
    for r in sorted(found, key=lambda r: (r.segment is not None, r.segment or 0, r.part)):
        assert r.rendered.count("<|im_start|>") == r.n_turns
        shown_turns.setdefault(r.conv_id, []).extend(r.rendered.split("<|im_end|>\n")[:-1])
    expected = brute(rows)
    assert shown_turns.keys() == expected.keys()
    for k, (n, copies, text) in expected.items():
        assert len(shown_turns[k]) == n and sorted(shown_turns[k]) == sorted(text.split("<|im_end|>\n")[:-1])
    assert {(r.conv_turns, r.n_copies) for r in found if r.conv_id is None} == {(3001, 1)}
    turn_of = {text: turn for conv_id, turn, _, text in crowd if conv_id is None}
    order = [turn_of[s.split("\n", 1)[1]] for s in shown_turns[None]]
    assert order == sorted(order)
