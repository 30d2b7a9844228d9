import random

from transitloom.llm import quotation
from transitloom.llm.quotation import LEAST_WORDS, link_conversations, normalise, parse_quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Per conversation the reply order by an explicit depth-first walk."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is None, turn, role or "", text or "", role))
    offers = {}
    for conv, messages in convs.items():
        messages.sort(key=lambda m: m[:3])
        for place, m in enumerate(messages):
            for p in quotation._passages(parse_quotes(m[3])[0]):
                offers.setdefault(p, []).append((conv if conv is not None else -(2**63), place))
    out = []
    for conv, messages in convs.items():
        key = conv if conv is not None else -(2**63)
        children, linked = {}, []
        for place, m in enumerate(messages):
            parent, n = None, 0
            for level, quote in parse_quotes(m[3])[1]:
                p = normalise(quote)
                if p.count(" ") + 1 < LEAST_WORDS:
                    continue
                own = [at for c, at in offers.get(p, []) if c == key and at < place]
                other = min(offers.get(p, []), default=None)
                if own:
                    n += 1
                    if level == 1 and parent is None:
                        parent = max(own)
                elif other and other[0] != key:
                    n += 1
            linked.append(n)
            children.setdefault(place - 1 if parent is None and place else parent, []).append(place)
        position, todo = 0, [c for c in reversed(children.get(None, []))]
        while todo:
            place = todo.pop()
            out.append((conv, messages[place][1], position, linked[place], parse_quotes(messages[place][3])[0]))
            position += 1
            todo += reversed(children.get(place, []))
    return sorted(out, key=str)


def test_parse_nested_levels():
    own, quotes = parse_quotes("On Monday Ann wrote:\n> > deep one\n>> deep two\n> shallow\n\nmy words\n>again\nend")
    assert own == "my words\nend"
    assert quotes == [(2, "deep one\ndeep two"), (1, "shallow"), (1, "again")]
    assert parse_quotes("") == ("", []) and parse_quotes("a > b") == ("a > b", [])


def test_reply_order_against_depth_first_walk(spark):
    rng = random.Random(5)
    rows = []
    for conv in [*range(12), None]:
        said = []
        for turn in range(rng.randrange(1, 25)):
            own = " ".join(f"w{rng.randrange(10**6)}" for _ in range(6))
            lines = []
            for at in rng.sample(range(len(said)), min(len(said), rng.choice([0, 0, 1, 2]))):
                level = rng.choice([1, 1, 2])
                lines += [">" * level + " " + said[at], "", own + " x"]
            rows.append((conv, turn if rng.random() < 0.97 else None, rng.choice(["user", "assistant"]), "\n".join([*lines, own])))
            said.append(own)
    rows.append((77, 0, "user", "> " + rows[0][3].split("\n")[-1] + "\nfrom elsewhere it came here"))
    got = link_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.conv_id, r.turn, r.position, r.linked, r.text) for r in got), key=str) == brute(rows)
    assert max(r.depth for r in got) > 1


def test_long_conversation_in_parts(spark, monkeypatch):
    monkeypatch.setattr(quotation, "PART", 4)
    rows = [(1, t, "user", f"message number {t} in order") for t in range(30)]
    rows[20] = (1, 20, "user", "> message number 3 in order\nback to three we go")
    rows[25] = (1, 25, "user", "> message number 10 in order\nback to ten we go")
    got = link_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.conv_id, r.turn, r.position, r.linked, r.text) for r in got) == sorted(brute(rows))
    order = [r.turn for r in sorted(got, key=lambda r: r.position)]
    assert order == [*range(20), *range(25, 30), *range(20, 25)]


def test_odd_rows(spark):
    rows = [(None, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (1, 1, None, "> " + "word " * 50_000), (2, 0, "user", ">")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS place", "2 AS conv", "'x' AS quotes")
    got = link_conversations(docs).collect()
    assert len(got) == len(rows) and sorted(r.position for r in got if r.conv_id == 1) == [0, 1, 2]
    assert link_conversations(docs.where("false")).count() == 0


def test_quotes_of_some_lines_short_quotes_and_other_conversations(spark):
    """Every run of consecutive lines of a message against a search for it, short quotes within the conversation only."""
    said = [f"alpha{k} beta{k} gamma{k} delta{k}" for k in range(7)]
    wrong = [said[0], said[1], said[3]]  # its lines are all there, but do not follow one another
    quotes = [said[i : i + k] for k in range(1, 8) for i in range(8 - k)] + [wrong, ["I agree"], [said[1], said[2], said[1]]]
    rows = [(1, 0, "user", "\n".join([*said[:3], "", *said[3:]])), (1, 1, "user", "I agree\nmore or less")]
    rows += [(1, 2 + k, "user", "\n".join(["> " + line for line in q] + [f"answer number {k} to it"])) for k, q in enumerate(quotes)]
    rows += [(2, 0, "user", "> I agree\nnothing like it was said here"), (2, 1, "user", f"> {said[4]}\n> {said[5]}\nelsewhere two lines stand")]
    # conversation 0 has the passage only behind its quote, conversation 3 has it too
    rows += [(0, 0, "user", "> one two three four five\nwho said so"), (0, 1, "user", "one two three four five"), (3, 0, "user", "one two three four five")]
    got = {(r.conv_id, r.turn): r for r in link_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k, q in enumerate(quotes):
        r = got[1, 2 + k]
        holds = any(said[i : i + len(q)] == q for i in range(8 - len(q)))
        assert (r.linked, r.parent_turn) == ((1, 0) if holds else (1, 1) if q == ["I agree"] else (0, 1 + k)), q
    assert [got[x].linked for x in ((2, 0), (2, 1), (0, 0))] == [0, 1, 1]


def plain_words(text):
    return "".join(c.lower() if c.isalnum() else " " for c in text).split()


def links_by_rule(rows):
    """How many quotes of each message link, and the turn that it replies to, with a parser and a rule of its own.

    A quote is found in a message that has its words as its whole own text, as a paragraph (however wrapped), or as lines in a row; one that
    is found nowhere so, in one that has all its words, two at least, side by side.
    """
    said = {}
    for conv, turn, _, text in rows:
        own, quotes, last = [], [], 0
        for line in text.split("\n"):
            level = 0
            while line.startswith(">"):
                level, line = level + 1, line[1:].lstrip(" ")
            if not level:
                own.append(line)
            elif level == last:
                quotes[-1][1].append(line)
            else:
                quotes.append((level, [line]))
            last = level
        said.setdefault(conv, []).append((turn, own, quotes))

    def holds(own, quote):
        flat = plain_words(" ".join(quote))
        paragraphs, now = [], []
        for line in [*own, ""]:
            if line.strip():
                now.append(line)
            elif now:
                paragraphs, now = [*paragraphs, plain_words(" ".join(now))], []
        lines, asked = ([w for w in map(plain_words, x) if w] for x in (own, quote))
        in_a_row = any(lines[k : k + len(asked)] == asked for k in range(len(lines) - len(asked) + 1))
        return flat == plain_words(" ".join(own)) or flat in paragraphs or in_a_row

    def inside(own, quote):
        flat, asked = plain_words(" ".join(own)), plain_words(" ".join(quote))
        return len(asked) > 1 and any(flat[k : k + len(asked)] == asked for k in range(len(flat) - len(asked) + 1))

    out = {}
    for conv, messages in said.items():
        messages.sort(key=lambda m: m[0])
        for place, (turn, _, quotes) in enumerate(messages):
            linked, parent = 0, messages[place - 1][0] if place else None
            first = True
            for level, quote in quotes:
                words = plain_words(" ".join(quote))
                for rule in (holds, inside):
                    here = [m[0] for m in messages[:place] if words and rule(m[1], quote)]
                    far = len(words) >= LEAST_WORDS and any(rule(m[1], quote) for c, ms in said.items() if c != conv for m in ms)
                    if here or far:
                        break
                linked += bool(here or far)
                if here and level == 1 and first:
                    parent, first = here[-1], False
            out[conv, turn] = (linked, parent)
    return out


def test_wrapped_and_partial_quotes_against_a_rule_of_its_own(spark):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(300)}"
    rows, bodies = [], []
    for conv in range(25):
        here = []
        for turn in range(rng.randrange(2, 9)):
            own = "\n\n".join("\n".join(" ".join(word() for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 4)))
            text = []
            for _ in range(rng.choice([0, 1, 1, 2])):
                source = rng.choice(here if here and rng.random() < 0.7 else bodies or [own])
                kind = rng.randrange(5)
                lines = [x for x in source.split("\n") if x]
                if kind == 0:
                    quote = source.split("\n")
                elif kind == 1:  # a paragraph, wrapped anew
                    flat = rng.choice(source.split("\n\n")).split()
                    quote = [" ".join(flat[k : k + 3]) for k in range(0, len(flat), 3)]
                elif kind == 2:  # some lines in a row
                    a, b = sorted(rng.sample(range(len(lines) + 1), 2))
                    quote = lines[a:b]
                elif kind == 3:
                    quote = [rng.choice(lines).upper() + "!"]
                else:
                    quote = [" ".join(word() for _ in range(4))]
                text += [*(">" * rng.choice([1, 1, 1, 2]) + " " + x for x in quote), "", f"answer {word()} {word()}", ""]
            rows.append((conv, turn, "user", "\n".join([*text, own])))
            here.append(own)
            bodies.append(own)
    # a passage that the quoter's conversation has later, and another one too
    rows += [(90, 0, "user", "> the one and only passage here\nso"), (90, 1, "user", "the one and only passage here"), (91, 0, "user", "the one and only passage here")]
    want = links_by_rule(rows)
    got = {(r.conv_id, r.turn): (r.linked, r.parent_turn) for r in link_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want and want[90, 0][0] == 1
    assert sum(n for n, _ in want.values()) > 60


def test_quotes_that_mailers_made_over(spark):
    """Wrapped anew over two paragraphs, with an omission, parts of lines, attributions of two lines, short quotes of other conversations."""
    rng = random.Random(21)
    rows, kinds, parents = [], {}, {}
    for conv in range(60):
        sentence = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(rng.randrange(9, 14)))
        paragraphs = [sentence() for _ in range(4)]
        rows += [(conv, 0, "user", f"{paragraphs[0]}\n{paragraphs[1]}.\n\n{paragraphs[2]}\n\n{paragraphs[3]}"), (conv, 1, "user", sentence()), (conv, 2, "user", sentence())]
        kind = ("wrapped", "omission", "inside", "attribution")[conv % 4]
        if kind == "wrapped":
            words = " ".join(paragraphs[1:3]).split()
            quote = "\n".join("> " + " ".join(words[k : k + 4]) for k in range(0, len(words), 4))
        elif kind == "omission":
            quote = f"> {paragraphs[0]}\n> [...]\n> {paragraphs[3]}"
        elif kind == "inside":
            quote = "> " + " ".join(paragraphs[2].split()[2:6])
        else:
            quote = f"On Mon, 3 Feb 2020 at 10:11, Some Body\n<some@body.example> wrote:\n> {paragraphs[3]}"
        rows.append((conv, 3, "user", f"{quote}\n\nmy answer {conv}"))
        kinds[conv], parents[conv] = kind, 0
    got = {r.conv_id: r for r in quotation.link_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("turn = 3").collect()}
    assert {c: r.parent_turn for c, r in got.items()} == parents
    assert all(r.linked == r.quotes == (2 if kinds[c] == "omission" else 1) for c, r in got.items())
    assert all(r.text == f"my answer {c}" for c, r in got.items())
    short = spark.createDataFrame([(1, 0, "user", "three odd words"), (2, 0, "user", "> three odd words\nyes")], "conv_id long, turn long, role string, text string")
    linked = lambda n: {r.conv_id: r.linked for r in quotation.link_conversations(short, n).collect()}[2]
    assert (linked(4), linked(3)) == (0, 1)
