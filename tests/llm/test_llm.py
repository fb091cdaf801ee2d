"""The training-text operators: brute force, round trips, held-out accuracy and edge cases."""

import datetime
import os
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from eventloom.llm import conversations, crf, encoding, leakage, near_duplicates, personal_info, reading_level

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def words(text):
    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


# --- personal data


def test_held_out_personal_info():
    examples = personal_info.labelled_examples()
    train, held = examples[: len(examples) * 3 // 4], examples[len(examples) * 3 // 4 :]
    types = personal_info._Types(crf.Tagger().fit(train))
    import pyarrow as pa

    tokens = [crf.pieces(t) for t, _ in held]
    first, end, kind, strings, codes = personal_info.found_spans(pa.array(tokens), types)
    ends = np.cumsum([len(t) for t in tokens])
    got = {(int(np.searchsorted(ends, a, "right")), personal_info.KINDS[k], "".join(strings[c] for c in codes[a:b]).strip()) for a, b, k in zip(first, end, kind, strict=True)}
    want = {(i, k, t[a:b]) for i, (t, spans) in enumerate(held) for a, b, k in spans}
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95


PAYLOAD = "delivery_seq bigint, kind string, payload struct<text:string,output:string,error:string,command:string,args:string>"


def test_personal_info_and_placeholders(spark):
    long = "The box shows the user. " * 4000
    rows = spark.createDataFrame(
        [
            (1, "x", ("Call me on +1-617-555-0197 if the deploy stalls.", None, "", None, '{"to":"marta.pellani@example.org","dry":true}')),
            (2, "x", (long + "cc petra.fenelund@ledger.test, petra.fenelund@ledger.test", None, None, None, None)),
            (3, "x", None), (None, "x", ("Ping a.b@example.org once", None, None, None, None)), (4, "x", ("ticket ZG-824-8212 \n", " ", None, "ls -la", None)),
        ], PAYLOAD,
    )
    got = sorted(personal_info.personal_info(rows).collect())
    assert [tuple(r) for r in got] == [
        (1, "args", "email", "marta.pellani@example.org"), (1, "text", "phone", "+1-617-555-0197"), (2, "text", "email", "petra.fenelund@ledger.test")
    ]
    clean = {r.delivery_seq: r for r in personal_info.redacted(rows).collect()}
    assert clean[1].text == "Call me on [PHONE] if the deploy stalls." and clean[1].args == '{"to":"[EMAIL]","dry":true}' and clean[1].error == ""
    assert clean[2].text == long + "cc [EMAIL], [EMAIL]" and clean[4].text == "ticket ZG-824-8212 \n" and clean[3].text is None
    assert personal_info.personal_info(rows.limit(0)).count() == 0


def test_names_of_new_words_are_found(spark):
    texts = ["The Graph holds The limit. M. Rossi wants it", "ENOENT: no such file routeEthloostLedger Ingrid Weber wants it"]
    rows = spark.createDataFrame([(i, "x", (t, None, None, None, None)) for i, t in enumerate(texts)], PAYLOAD)
    assert sorted((r.delivery_seq, r.kind, r.found_text) for r in personal_info.personal_info(rows).collect()) == [(0, "name", "M. Rossi"), (1, "name", "Ingrid Weber")]


UNSEEN = [
    ("Wilhelmina Oduya asked for a second review of the parser.", ["name|Wilhelmina Oduya"]),
    ("The ticket was closed by Ignatius Thackeray yesterday.", ["name|Ignatius Thackeray"]),
    ("cc Siobhan O'Rourke and Kwame Nkrumah-Boateng", ["name|Siobhan O'Rourke", "name|Kwame Nkrumah-Boateng"]),
    ("Author: Dmitri Volkonsky <dmitri.volkonsky@kremlinpost.ru>", ["name|Dmitri Volkonsky", "email|dmitri.volkonsky@kremlinpost.ru"]),
    ("Priya Raghunathan said the limit is wrong", ["name|Priya Raghunathan"]),
    ("please write to john.smith@corp-mail.co.uk or alice_b@staatsarchiv.edu", ["email|john.smith@corp-mail.co.uk", "email|alice_b@staatsarchiv.edu"]),
    ("forwarded from <bjorn.angstrom@kth-labs.se>: the job is red", ["email|bjorn.angstrom@kth-labs.se"]),
    ("Mail an m.mueller@werkstatt-nord.at reicht.", ["email|m.mueller@werkstatt-nord.at"]),
    ("ring 212-555-0187 or 030 1234567 after lunch", ["phone|212-555-0187", "phone|030 1234567"]),
    ("abita in via Garibaldi 18 da marzo", ["address|via Garibaldi 18"]),
    ("ship it to 42 Elm Street, Springfield by Friday", ["address|42 Elm Street"]),
    ("Adresse: Hauptstraße 12", ["address|Hauptstraße 12"]),
    ("spedire a via Roma 5 entro lunedì", ["address|via Roma 5"]),
    ("The courier went to 1187 Pemberton Terrace instead", ["address|1187 Pemberton Terrace"]),
    ("Thanks,\nRosalind Featherstone\n+61 2 9374 4000", ["name|Rosalind Featherstone", "phone|+61 2 9374 4000"]),
    ("user: Tadashi Morinaga, phone +81 3 1234 5678", ["name|Tadashi Morinaga", "phone|+81 3 1234 5678"]),
    ("contact_phone=+41 44 668 18 00 contact_name=\"Ueli Zurbriggen\"", ["phone|+41 44 668 18 00", "name|Ueli Zurbriggen"]),
    ("{\"name\":\"Xiomara Quintanilla\",\"phone\":\"(787) 555-0142\"}", ["name|Xiomara Quintanilla", "phone|(787) 555-0142"]),
    ("moved from 9 Wisteria Close to 310 Juniper Boulevard last month", ["address|9 Wisteria Close", "address|310 Juniper Boulevard"]),
    ("Frau Liselotte Pfannenschmidt wohnt in der Kastanienallee 77", ["name|Liselotte Pfannenschmidt", "address|Kastanienallee 77"]),
    ("il sig. Ermenegildo Zaccagnini aspetta in piazza Bernini, 4", ["name|Ermenegildo Zaccagnini", "address|piazza Bernini, 4"]),
    ("deliver to\nGulnara Iskakova\nFlat 6, 28 Harrowgate Road\nDundee", ["name|Gulnara Iskakova", "address|Flat 6, 28 Harrowgate Road"]),
    ("Signed-off-by: Thelonious Abernathy <t.abernathy@jazzclub.fm>", ["name|Thelonious Abernathy", "email|t.abernathy@jazzclub.fm"]),
    ("reported by Ngozi Chukwuemeka (ngozi_c@lagosweb.ng)", ["name|Ngozi Chukwuemeka", "email|ngozi_c@lagosweb.ng"]),
    ("Reviewed-by: Bartholomew Quigley", ["name|Bartholomew Quigley"]),
    ("according to Svetlana Rozhdestvenskaya the rollout is frozen", ["name|Svetlana Rozhdestvenskaya"]),
    ("Please loop in Caoimhe Fitzsimmons before the merge.", ["name|Caoimhe Fitzsimmons"]),
    ("meeting with Ms Oluwaseun Adebayo at nine, bring 523-44-7781", ["name|Oluwaseun Adebayo", "id_number|523-44-7781"]),
    ("expected 'Anneliese Vandenberghe' but got 'T. Vandenberghe'", ["name|Anneliese Vandenberghe", "name|T. Vandenberghe"]),
    ("SSN: 601 22 9084", ["id_number|601 22 9084"]),
    ("codice fiscale RSSMRA85T10A562S", ["id_number|RSSMRA85T10A562S"]),
    ("Owner Percival Hargreaves / 0161 496 0733 / percival@hargreaves-sons.ie", ["name|Percival Hargreaves", "phone|0161 496 0733", "email|percival@hargreaves-sons.ie"]),
    ("call +351 21 780 3000 now", ["phone|+351 21 780 3000"]),
    ("phone: 604.555.0163", ["phone|604.555.0163"]),
    ("Rückruf unter 0911 447120.", ["phone|0911 447120"]),
    ("chiamami al 349 8812345", ["phone|349 8812345"]),
    ("From: k.yilmaz@ankara-bt.com.tr\nTo: helpdesk.two@citymuseum.museum", ["email|k.yilmaz@ankara-bt.com.tr", "email|helpdesk.two@citymuseum.museum"]),
    ("geliefert an Eichendorffstr. 31", ["address|Eichendorffstr. 31"]),
    ("office at 77 Copenhagen Wharf Lane is closed", ["address|77 Copenhagen Wharf Lane"]),
    ("12, rue Saint-Honoré", ["address|12, rue Saint-Honoré"]),
    ("Mr. Cornelius Blackwood rejects the proposal", ["name|Cornelius Blackwood"]),
    ("der Kunde Reinhold Mitterlehner hat angerufen", ["name|Reinhold Mitterlehner"]),
    ("national id 71 205 338 946 from the import", ["id_number|71 205 338 946"]),
    ("- Philippa Ravensdale: 01865 270000", ["name|Philippa Ravensdale", "phone|01865 270000"]),
    ("the build 2031.44 of module Quartz Lantern failed at step 12", []),
    ("Merge Conflict Resolver returns 4102 rows in src/app/Main.java", []),
    ("Thursday Evening sync: Roadmap Planning and Budget Review", []),
    ("Der Rechner zeigt das Diagramm unter hohen Lasten", []),
    ("npm install left-pad@1.3.0 && git clone git@codeberg.org:foo/bar.git", []),
    ("Il Consiglio approva la Relazione Annuale senza modifiche", []),
    ("order 7781-22-9901 shipped, trace 9910284477 ok", []),
    ("Kubernetes Ingress Controller drops the Connection Pool", []),
]


def _tagged(texts, types):
    """The pieces found in each text: ``(text, kind, piece)``."""
    import pyarrow as pa

    tokens = [crf.pieces(t) for t in texts]
    first, end, kind, strings, codes = personal_info.found_spans(pa.array(tokens), types)
    rows = np.searchsorted(np.cumsum([len(t) for t in tokens]), first, "right")
    return {(int(r), personal_info.KINDS[k], "".join(strings[c] for c in codes[a:b]).strip()) for r, a, b, k in zip(rows, first, end, kind, strict=True)}


def test_unseen_names_domains_streets_and_numbers():
    """Names, domains, streets and groupings of which no labelled line has the words."""
    given = {w.lower() for _, spans in UNSEEN for s in spans if s.startswith("name") for w in words(s[5:]) if len(w) > 1}
    known = {w for text, spans in personal_info.labelled_examples() for a, b, k in spans if k == "name" for w in words(text[a:b])}
    assert len(given & known) <= 2
    got = _tagged([t for t, _ in UNSEEN], personal_info._Types(personal_info.trained_tagger()))
    want = {(i, *s.split("|")) for i, (_, spans) in enumerate(UNSEEN) for s in spans}
    emails = {s for i, kind, s in want if kind == "email"}
    assert emails <= {s for _, _, s in got}  # none is cut
    assert len(got & want) / len(want) >= 0.9 and len(got & want) / len(got) >= 0.93


def test_nothing_but_what_is_certain_is_left_out_of_decoding():
    """The pieces that are not decoded are outside in the best path over all pieces."""
    types = personal_info._Types(personal_info.trained_tagger())
    texts = [t for t, _ in personal_info.labelled_examples()[:400]] + [t for t, _ in UNSEEN]
    short, kept = _tagged(texts, types), personal_info.certainly_outside
    try:
        personal_info.certainly_outside = lambda scores, last, moves: np.zeros(len(scores), bool)
        assert _tagged(texts, types) == short
    finally:
        personal_info.certainly_outside = kept


def test_pieces_join_to_the_text():
    for text in ["", " \t\n", "a1２é́😀 x\r\n", "  lead", "trail  "]:
        assert "".join(crf.pieces(text)) == text


def test_viterbi_is_the_best_path():
    rng, n = np.random.default_rng(1), len(crf.LABELS)
    scores, moves = rng.normal(size=(7, n)).astype(np.float32), rng.normal(size=(n, n)).astype(np.float32)
    got = crf.viterbi(scores, np.array([0, 3]), np.array([3, 4]), moves)

    def value(path, at):
        return moves[0, path[0]] + sum(scores[at + i, p] for i, p in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)) + moves[path[-1], 0]

    best = max(((a, b, c) for a in range(n) for b in range(n) for c in range(n)), key=lambda p: value(p, 0))
    assert tuple(got[:3]) == best


# --- near-duplicates

ITEMS = "id string, category string, text string, words string, node bigint"


def test_similar_items_of_random_edits(spark):
    rng, rows = random.Random(2), []
    for i in range(160):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(8, 30))]
        for j in range(rng.choice([1, 1, 2, 3])):
            text = [w if rng.random() > 0.12 * j else f"z{rng.randrange(3000)}" for w in base]
            rng.shuffle(text)
            rows.append((f"m{i}_{j}", rng.choice(["a", "a", "b"]), " ".join(text).upper() if j else " ".join(text), "x", 1))
    rows += [("n1", None, "one two three four five six seven eight", "x", 1), ("n2", "a", None, "x", 1), ("n3", "a", "", "x", 1), ("n4", "a", "a b c", "x", 1), ("n5", "a", "a b c", "x", 1), (None, "a", rows[0][2], "x", 1)]
    rows += [rows[0], ("copy", rows[0][1], rows[0][2], "x", 1), ("copy2", rows[0][1], rows[0][2] + " !", "x", 1)]
    want, sets = set(), [(i, c, set(words(t))) for i, c, t, _, _ in rows if i and c and len(set(words(t))) >= 8]
    for i, c, s in sets:
        for j, d, t in sets:
            if i < j and c == d and len(s & t) >= 0.6 * len(s | t):
                want.add((i, j))
    items = spark.createDataFrame(rows, ITEMS)
    got = [tuple(r) for r in near_duplicates.similar_pairs(items).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.99 * len(want) > 30
    groups = {r.id: r.group_id for r in near_duplicates.similar_groups(items).collect()}
    assert set(groups) == {x for p in got for x in p} and all(groups[a] == groups[b] for a, b in got)


def test_no_items(spark):
    assert near_duplicates.similar_pairs(spark.createDataFrame([], ITEMS)).count() == 0


def test_circulant_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2**63, 200).astype(np.uint64), rng.integers(0, 2**63, 50).astype(np.uint64)
    one, two = a, np.concatenate([a[:150], b])
    signature = near_duplicates.signatures(np.concatenate([one, two]), np.array([0, 200, 400]), 1024)
    assert abs((signature[:, 0] == signature[:, 1]).mean() - 150 / 250) < 0.06


def _template(n):
    """Items of one phrase with changing numbers, which share their buckets without being equal, and a few far off it."""
    base = " ".join(WORDS[:14])
    rows = [(f"t{i:05}", "goals", f"{base} n{i} m{i % 7}", "x", 1) for i in range(n)]
    return rows + [(f"u{i}", "goals", " ".join(WORDS[:11]) + f" u{i} v{i} w{i} x{i} y{i}", "x", 1) for i in range(4)]


def test_hot_buckets_are_split_and_lose_no_pair(spark):
    rows = _template(70)
    items = spark.createDataFrame(rows, ITEMS)
    sets = {r[0]: set(words(r[2])) for r in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    found = {tuple(r) for r in near_duplicates.similar_pairs(items, rows=2, bands=40, hot=16).collect()}
    assert found == {tuple(r) for r in near_duplicates.similar_pairs(items, rows=2, bands=40).collect()} == want
    groups = {r.id: r.group_id for r in near_duplicates.similar_groups(items, rows=2, bands=40, hot=16).collect()}
    assert groups == {r.id: r.group_id for r in near_duplicates.similar_groups(items, rows=2, bands=40).collect()}
    assert {groups[f"t{i:05}"] for i in range(70)} == {"t00000"}


def test_one_template_in_many_items(spark):
    groups = near_duplicates.similar_groups(spark.createDataFrame(_template(50_000), ITEMS), bands=12)
    assert groups.where("group_id = 't00000'").count() == 50_000


# --- conversations

EVENTS = (
    "delivery_seq bigint, id string, session_id string, ordinal int, ts timestamp, type string, dedupe_hash string, "
    "payload struct<text:string,tool_use_id:string,task:string>, role string, turn int"
)


def _talk(turns, session="s", start=0, quote=None):
    return [
        (start + i, f"{session}{start + i}", session, i if o is None else o, None, "USER_MESSAGE" if who == "u" else "ASSISTANT_MESSAGE", None, (text, None, None), "x", 9)
        for i, (who, text, o) in enumerate(turns)
    ]


@pytest.mark.parametrize("long", [3, 100_000])
def test_conversations(spark, long):
    rows = _talk([("u", "hi", None), ("a", "yes", None), ("a", "more", None), ("u", "ok", None), ("a", "end", None)], "good", 100)
    rows += [(199, "good100", "good", 0, None, "USER_MESSAGE", None, ("hi", None, None), "x", 9)]  # a repeated delivery
    rows += [(198, "g9", "good", 2, None, "USER_MESSAGE", None, (" - ", None, None), "x", 9), (197, "g8", "good", 2, None, "TOOL_CALL", None, None, "x", 9)]  # no messages
    rows += _talk([("a", "x", None), ("u", "y", None), ("a", "z", None)], "first", 200)
    rows += _talk([("u", "x", None), ("a", "y", None), ("u", "z", None)], "last", 300)
    rows += _talk([("u", "x", None), ("u", "y", None), ("a", "z", None)], "two", 400)
    rows += _talk([("u", "x", 1), ("a", "y", 1)], "tie", 500)
    rows += [(600, "p1", "noplace", None, None, "USER_MESSAGE", None, ("x", None, None), "x", 9), (601, "p2", "noplace", 1, None, "ASSISTANT_MESSAGE", None, ("x", None, None), "x", 9)]
    rows += _talk([("u" if i % 2 == 0 else "a", f"t{i}", None) for i in range(40)], "long", 700)
    got = sorted(tuple(r) for r in conversations.conversations(spark.createDataFrame(rows, EVENTS), long, 4).collect())
    want = [("good", i + 1, r, 100 + i) for i, r in enumerate(["user", "assistant", "assistant", "user", "assistant"])]
    want += [("long", i + 1, "user" if i % 2 == 0 else "assistant", 700 + i) for i in range(40)]
    assert got == sorted(want)


def test_conversations_without_session(spark):
    ask, answer = "how do I run it", "> how do I run it\nwith make"
    rows = _talk([("u", ask, None)], None, 1) + [(2, "b", None, 5, None, "ASSISTANT_MESSAGE", None, (answer, None, None), "x", 9)]
    rows += [(9, "c", None, 5, None, "ASSISTANT_MESSAGE", None, ("alone", None, None), "x", 9)]
    rows += _talk([("u", "start here please", None)], "s1", 20) + [(30, "d", None, 7, None, "ASSISTANT_MESSAGE", None, ("> start here please\ndone", None, None), "x", 9)]
    got = sorted(tuple(r) for r in conversations.conversations(spark.createDataFrame(rows, EVENTS)).collect())
    assert got == [("conversation:1", 1, "user", 1), ("conversation:1", 2, "assistant", 2), ("s1", 1, "user", 20), ("s1", 2, "assistant", 30)]


def test_links_of_messages_without_session(spark):
    """True and false reply and quote links beside messages that have a session."""
    use = lambda text, key: (text, key, None)
    event = lambda seq, session, place, kind, payload, ts=None: (seq, f"e{seq}", session, place, ts, kind, None, payload, "x", 9)
    when = lambda hour: datetime.datetime(2026, 1, 1 + hour // 24, hour % 24)
    rows = [
        event(1, "s1", 0, "USER_MESSAGE", use("run the tests", "t1"), when(0)), event(2, None, 1, "ASSISTANT_MESSAGE", use("done with t1", "t1")),  # a reply into a session
        event(3, "s2", 0, "USER_MESSAGE", use("ok", None)), event(4, None, 1, "ASSISTANT_MESSAGE", use("> ok\nwhat now", None)),  # too short to be a link
        event(5, None, 0, "USER_MESSAGE", use("please check the parser", None), when(1)), event(6, None, 1, "ASSISTANT_MESSAGE", use("> please check the parser\nit holds", None), when(2)),
        event(7, "s3", 0, "USER_MESSAGE", use("please check the parser", None), when(99)),  # the same line elsewhere, later
        event(8, None, 1, "ASSISTANT_MESSAGE", use("> run the tests\nlong ago", None), when(90)), event(9, "s4", 0, "USER_MESSAGE", use("run the tests", None), when(9)),  # a day apart
    ]
    events = spark.createDataFrame(rows, EVENTS)
    links = {tuple(sorted(r)) for r in conversations.reply_and_quote_links(events).collect()}
    assert links == {(1, 2), (5, 6)}


def test_long_conversations_are_as_short_ones(spark):
    """Ordering in ranges gives the same at the border and on either side of it."""
    rows = _talk([("u" if i % 2 == 0 else "a", f"t{i}", None) for i in range(8)], "even", 100) + _talk([("u", "x", None), ("a", "y", None), ("u", "z", None)], "odd", 200)
    events = spark.createDataFrame(rows, EVENTS)
    every = [sorted(tuple(r) for r in conversations.conversations(events, long, 3).collect()) for long in (7, 8, 100_000)]
    assert every[0] == every[1] == every[2] and len(every[0]) == 8


def test_no_conversations(spark):
    assert conversations.conversations(spark.createDataFrame([], EVENTS)).count() == 0


# --- encoding


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no tokenizer files")
def test_encoding_and_round_trip(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(encoding, "BLOCK_WORDS", 50)
    texts = [None, "", " ", "  two  spaces ", "it's we'll I'D", "<|endoftext|> x", "a b c\r\n\n\td", "日本語 ١٢٣ ½ 😀👍🏽", "é ͸\U0001fae9 \U00031350", "word " * 3000, "x" * 4000, "tab\t\x1c\x85end", "dup", "dup"]
    docs = spark.createDataFrame([(i, t, "w") for i, t in enumerate(texts)] + [(None, "null id", "w")], "doc_id bigint, text string, word string")
    ranks = encoding.rank_file(RANKS)
    encoded = encoding.encode_corpus(docs, ranks).cache()
    tool = Tokenizer.from_file(RANKS.replace(".tiktoken", ".json"))
    tool.encode_special_tokens = True
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        assert got[i] == tool.encode(t or "", add_special_tokens=False).ids, (i, t)
    back = {r.doc_id: r.text for r in encoding.decode_ids(encoded, ranks).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    assert encoding.encode_corpus(docs.limit(0), ranks).count() == 0


# --- leaked test passages


@pytest.mark.parametrize("broadcast_rows", [0, 500_000])
def test_leaked_items_of_random_texts(spark, broadcast_rows):
    rng = random.Random(4)
    text = lambda n: [rng.choice(WORDS) for _ in range(n)]
    items = [(i, " ".join(text(rng.randrange(5, 60))), "x") for i in range(30)] + [(90, None, "x"), (91, "", "x"), (None, "a " * 20, "x"), (92, "ha " * 40, "x")]
    docs = []
    for d in range(120):
        body = text(rng.randrange(0, 150))
        if d % 2:
            source = words(items[rng.randrange(30)][1])
            size = rng.randrange(8, 20)
            at = rng.randrange(max(1, len(source) - size + 1))
            body[10:10] = source[at : at + size]
        docs.append((d, ", ".join(body).title(), "y"))
    docs += [(500, None, "y"), (501, "", "y"), (502, "Ha! " * 5000, "y"), docs[1], (None, docs[1][1], "y")]
    grams = {}
    for i, t, _ in items:
        if i is not None:
            w = words(t)
            for j in range(len(w) - 11):
                grams.setdefault(tuple(w[j : j + 12]), set()).add(i)
    want = set()
    for d, t, _ in docs:
        w = words(t)
        for j in range(len(w) - 11):
            want |= {(d, i) for i in grams.get(tuple(w[j : j + 12]), ()) if d is not None}
    found = leakage.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string, hash string"), spark.createDataFrame(items, "item_id bigint, text string, key string"), broadcast_rows=broadcast_rows)
    got = [(r.doc_id, r.item_id) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_no_leaks(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert leakage.leaked_items(docs, spark.createDataFrame([(1, "a " * 30)], "item_id bigint, text string")).count() == 0


# --- reading level


def _prose(rng, level):
    easy, hard = "the cat sees a box and runs home fast".split(), "notwithstanding infrastructural heterogeneity the organisation operationalises retrospective reconciliation methodologies insofar".split()
    out = []
    for _ in range(40 // level):
        out.append(" ".join(rng.choice(hard if rng.random() < (level - 1) / 3 else easy) for _ in range(4 * level)) + ".")
    return " ".join(out)


def test_held_out_reading_levels(spark):
    rng = random.Random(6)
    truth = {i: 1 + i % 4 for i in range(160)}
    docs = [(i, _prose(rng, k), "x") for i, k in truth.items()]
    docs += [(900, None, "x"), (901, "too short", "x"), (None, docs[0][1], "x"), (902, "```\n" + "code_line(1) " * 60 + "\n```", "x"), (903, docs[3][1] * 300, "x"), docs[5]]
    labels = [(i, k, "a") for i, k in truth.items() if i % 3 == 0] + [(0, None, "b"), (None, 3, "b"), (3, 9, "b"), (777, 2, "b")]
    documents, given = spark.createDataFrame(docs, "doc_id bigint, text string, language string"), spark.createDataFrame(labels, "doc_id bigint, reading_level int, share string")
    rows = reading_level.reading_levels(documents, given).collect()
    got = {r.doc_id: r.reading_level for r in rows}
    assert set(got) == set(truth) | {902, 903} and len(rows) == len(got) + 1 and got[903] == 4
    held = [i for i in truth if i % 3]
    assert np.mean([got[i] == truth[i] for i in held]) > 0.9
    bare = {r.doc_id: r.reading_level for r in reading_level.reading_levels(documents, given.limit(0)).collect()}
    assert np.mean([abs(bare[i] - truth[i]) <= 1 for i in truth]) > 0.8
    assert reading_level.reading_levels(documents.limit(0), given).count() == 0


@pytest.mark.parametrize("broadcast_rows", [0, 500_000])
def test_test_passages_do_not_count_in_the_level(spark, broadcast_rows):
    rng = random.Random(7)
    passage = " ".join(rng.choice(WORDS) for _ in range(60))
    items = spark.createDataFrame([(1, passage, None), (2, None, None)], "item_id bigint, text string, answer string")
    own = {i: _prose(rng, 1 + i % 4) for i in range(40)}
    quoted = {i: f"{t} Q: {passage.title().replace(' ', ', ', 9)}.\n" if i % 2 == 0 else f"{passage}! {t}" for i, t in own.items()}
    labels = spark.createDataFrame([(i, 1 + i % 4, "a") for i in own if i % 3], "doc_id bigint, reading_level int, annotator string")
    kind = "doc_id bigint, text string"
    short = "the cat sees. " + " ".join(passage.split()[:38])  # 40 words only with the passage
    bare = {r.doc_id: r.reading_level for r in reading_level.reading_levels(spark.createDataFrame([*own.items()], kind), labels).collect()}
    docs = spark.createDataFrame([*quoted.items(), (90, passage + " " + passage), (91, short), (7, own[7])], kind)
    rows = reading_level.reading_levels(docs, labels, items=items, broadcast_rows=broadcast_rows).collect()
    got = {r.doc_id: r.reading_level for r in rows}
    assert {i: got[i] for i in own} == bare and got[90] == 1 and 91 in got and len(rows) == len(own) + 3


def test_another_language_has_models_of_its_own(spark):
    """Texts without a function word of the three languages are told apart by their sentences, whatever English has."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("абвгдежзик") for _ in range(6))
    said = lambda n, k: " ".join(" ".join(word() for _ in range(n)) + "." for _ in range(k))
    docs = [(i, said(4, 20)) for i in range(4)] + [(10 + i, said(30, 4)) for i in range(4)] + [(20 + i, "the cat and the dog run to it. " * 8) for i in range(4)]
    labels = spark.createDataFrame([(20 + i, 2) for i in range(4)], "doc_id bigint, reading_level int")
    got = {r.doc_id: r.reading_level for r in reading_level.reading_levels(spark.createDataFrame(docs, "doc_id bigint, text string"), labels).collect()}
    assert {got[i] for i in range(4)} == {1} and {got[10 + i] for i in range(4)} == {4} and {got[20 + i] for i in range(4)} == {2}


def test_passages_are_cut_out_of_the_prose(spark):
    run = " ".join(f"{w}" for w in WORDS[:12])
    texts = [f'He said: "{run}." Then.', f"```\n{run}\n```\nx {run}; y", f"İz {run.upper()}\n12:30:01 log {run}\nend.", f"{run[:-4]} near."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "so " + run)], "item_id bigint, text string")
    spans = leakage.passages(docs, items)
    rows = docs.join(spans, "doc_id").select("doc_id", "spans", reading_level.text_pieces(F.col("text")).alias("p")).collect()
    import pyarrow as pa

    of = lambda values, name: np.array([v[name] for v in values])
    rest = lambda r: reading_level._without_spans(pa.array([p.piece for p in r.p]), of(r.p, "n"), of(r.spans, "first"), of(r.spans, "end"))
    got = {r.doc_id: rest(r).split() for r in rows}
    assert got == {0: ["He", "said:", '"', "Then."], 1: ["x", "y"], 2: ["İz", "end."]}


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no tokenizer files")
@pytest.mark.parametrize("name", ["p5_found", "p6_text", "p7_found"])
def test_query_equals_sql(spark, data, duck, name):
    from eventloom.llm import queries
    from tests.compare import check

    check(queries.QUERIES[name](spark, data), duck.sql(queries.SQL[name]))


def test_queries_run(spark, data):
    from eventloom.llm import queries

    assert queries.p6_ids(spark, data).select(F.count("*")).first()[0] == spark.read.parquet(f"{data}/documents.parquet").count()
    assert set(queries.QUERIES) >= {"p1_found", "p3_found", "p5_found", "p6_ids", "p7_found", "p8_found"}
