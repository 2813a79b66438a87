"""Quotes that are nested, short, or of several paragraphs."""

from passerelle.llm import quotes


def test_nested_short_and_split_quotes(spark):
    rows = [
        (1, 0, "Which way leads to the old harbour?\n\nAnd when does the last ferry leave?"),
        (1, 1, "> Which way leads to the old harbour?\n\nI agree"),
        (1, 2, ">> Which way leads to the old harbour?\n\nLeft, at the mill."),
        (1, 3, "> I agree\nSo do I."),
        (1, 4, "> Which way leads to\n> the old harbour?\n>\n> And when does the last\n> ferry leave?\n\nAt nine."),
        (1, 5, ">> And when does the last ferry leave?\nNobody quoted that one alone before."),
        (1, 6, "> I agree\n> Left, at the mill.\nFine."),
        (2, 0, "Only a question that is said here."),
        (2, 1, ">>> Only a question that is said here.\nDeep."),
        (2, 2, ">\n> \nnothing quoted"),
    ]
    out = quotes.linked(spark.createDataFrame(rows, "conv_id long, turn int, text string")).collect()
    got = {(r["conv_id"], r["turn"]): r["reply_to"] for r in out}
    assert got == {(1, 0): None, (1, 1): 0, (1, 2): 1, (1, 3): 1, (1, 4): 0, (1, 5): 4, (1, 6): 2, (2, 0): None, (2, 1): 0, (2, 2): None}
    assert next(r["thread"] for r in out if (r["conv_id"], r["turn"]) == (1, 2)) == 0


def brute_links(messages, least=12):
    """reply_to of each (conversation, turn), by comparing every quote with every message before."""
    out = {}
    for conv in {c for c, _, _ in messages}:
        own = sorted((t, quotes.parse(text)) for c, t, text in messages if c == conv)
        first = {}
        for turn, (_, _, said, quoted) in own:
            for key in [(0, h) for h in said] + [(level, h) for level, h, _ in quoted]:
                first.setdefault(key, turn)
        for turn, (_, _, _, quoted) in own:
            score = {}
            for level, h, n in quoted:
                for at, kind in {(level - 1, 0 if level == 1 else 1)} | ({(0, 2)} if level > 1 else set()):
                    said = first.get((at, h))
                    if said is not None and said < turn:
                        own_score = score.setdefault(said, [0] * 6)
                        own_score[kind + (0 if n >= least else 3)] += n
            out[conv, turn] = max(score, key=lambda s: (score[s], s)) if score else None
    return out


def test_conversations_with_quotes_against_brute_force(spark):
    rows = quotes.with_quotes(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    messages = [(r["conv_id"], r["turn"], r["text"]) for r in rows.collect()]
    got = {(r["conv_id"], r["turn"]): r for r in quotes.quoted_conversations(spark, "/root/testdata/sf0.001").collect()}
    want = brute_links(messages)
    assert {k: r["reply_to"] for k, r in got.items()} == want
    assert sum(v is not None for v in want.values()) > 0.5 * len(want)
    for (conv, turn), r in got.items():
        chain, at = 0, turn
        while want[conv, at] is not None:
            chain, at = chain + 1, want[conv, at]
        assert (r["thread"], r["depth"]) == (at, chain)
    by = {(c, t): text for c, t, text in messages}
    assert all(">" not in (r["own_text"] or "")[:1] and r["n_quotes"] > 0 for (c, t), r in got.items() if (by[c, t] or "").startswith(">"))
