"""The llm operators' functions against brute force, round trips and held-out cases."""

import math
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm import abuse, abuse_seed, chunking, codetext, langid, mojibake, packing, pairs, tokens
from loomtext.llm.suffix import Automaton

TEXT = st.text(st.sampled_from("ab c.\n！。é\r\t😀́"), max_size=300)


# -- p1 --------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(1, 60), st.integers(0, 70))
def test_pieces_cover_the_text(text, limit, overlap):
    p = chunking.split(text, limit, overlap)
    o = max(0, min(overlap, limit - 1))
    assert p[0][0] == 0 and p[-1][1] == len(text)
    for (a, b, _), (c, d, _) in zip(p, p[1:]):
        assert c == b - o and d > b
    assert all(b - a <= limit for a, b, _ in p)
    joined = text[p[0][0] : p[0][1]] + "".join(text[q[1] : r[1]] for q, r in zip(p, p[1:]))
    assert joined == text


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_longest_run(text):
    runs, n = [0], 0
    for c in text:
        n = 0 if c in chunking.BREAKS else n + 1
        runs.append(n)
    assert chunking.longest_run(chunking.points(text)) == max(runs)


def test_natural_cuts_and_edits_stay_local():
    rng = random.Random(1)
    text = " ".join(f"Sentence {rng.randint(0, 9999)} has some {rng.choice(['long', 'short', 'odd'])} words." for _ in range(400))
    p = chunking.split(text, 400, 40)
    assert all(how == "sentence" for *_, how in p[:-1])
    edited = text[:5000] + "X" + text[5000:]
    q = {text_ for a, b, _ in chunking.split(edited, 400, 40) if (text_ := edited[a:b])}
    lost = [text[a:b] for a, b, _ in p if text[a:b] not in q]
    assert len(lost) <= len(p) // 3  # the cuts fall in again behind the edit
    assert chunking.split("x" * 50, 20, 5)[0] == (0, 20, "forced")


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(1, 60), st.integers(0, 70))
def test_kind_of_cut_is_that_of_the_longest_run(text, limit, overlap):
    want = chunking.longest_run(chunking.points(text)) > limit
    assert chunking.kind_of_cut(text, limit, overlap) == ("forced" if want else "natural")
    if want:
        assert any(how == "forced" for *_, how in chunking.split(text, limit, overlap))


def test_a_blank_behind_a_full_piece_is_natural():
    assert chunking.split("abcde fghij klmno", 5, 0)[0] == (0, 5, "blank")


def test_forced_cuts_keep_marks_together():
    assert chunking.split("e" + "́" + "a" * 3, 1, 0)[0][1] == 1
    assert all(not t.startswith("\n") for a, b, _ in chunking.split("a\r\n" * 20, 7, 0) if (t := ("a\r\n" * 20)[a:b]))


# -- p6 --------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.just(1), st.integers(0, 12), st.integers(0, 6)), max_size=40), st.integers(1, 6))
def test_containers_hold(items, most):
    items = [(t, c, min(c, x)) for t, c, x in items]
    no = packing.pack(items, (most, 12, 12))
    assert len(no) == len(items)
    for n in set(no):
        own = [i for i, k in zip(items, no) if k == n]
        assert len(own) <= most and sum(c for _, c, _ in own) <= 12
    least = max(-(-len(items) // most), -(-sum(c for _, c, _ in items) // 12))
    assert len(set(no)) <= 2 * least + 1


def test_oversized_items_are_alone():
    no = packing.pack([(1, 50), (1, 3), (1, 3)], (5, 10))
    assert no[1] == no[2] != no[0]
    assert packing.pack([], (1, 1)) == []


# -- p8 --------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=200), st.integers(1, 9))
def test_chunked_encoding_is_exact(text, size):
    whole = tokens.encode(text)
    assert tokens.encode(text, size=size) == whole
    assert tokens.decode(whole) == text.encode()


def test_encoding_against_the_other_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in ("Hello  world\n\n it's", "世界 😀", "x" * 3000, "<|endoftext|>", "  \t a"):
        assert tokens.encode(text) == t.encode(text, add_special_tokens=False).ids
    assert tokens.encode(None) == tokens.encode("") == [] and tokens.decode(None) == b""


# -- suffix automata and p4 ----------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.text("ab", max_size=25), st.text("abc", max_size=25), st.integers(1, 4))
def test_automaton(text, other, least):
    a = Automaton(text)
    n = i = 0
    while i < len(other):
        k = max((m for m in range(len(other) - i + 1) if other[i : i + m] in text), default=0)
        i += max(1, k)
        n += 1
    assert a.phrases(other) == n
    covered = {j for i in range(len(other)) for j in range(i, i + least) if i + least <= len(other) and other[i : i + least] in text}
    assert a.coverage(other, least) == len(covered)


SAMPLES = {
    "en": ["The file was not found, so a new one is created.", "Do not change the server while another thread is using it.", "Users can now open the block without entering a password."],
    "de": ["Die Datei wurde nicht gefunden und wird deshalb neu angelegt.", "Den Prozess nicht ändern, solange ein anderer Thread darauf zugreift.", "Benutzer können den Server jetzt ohne Passwort öffnen."],
    "fr": ["Le fichier est introuvable, on en crée donc un nouveau.", "Ne modifiez pas le serveur tant qu'un autre fil l'utilise.", "Les utilisateurs peuvent désormais ouvrir le bloc sans mot de passe."],
    "zh": ["找不到文件，因此会新建一个。", "其他线程正在使用时，请勿修改服务器。"],
    "ja": ["ファイルが見つからないため、新しく作成します。", "別のスレッドが使用している間は変更しないでください。"],
    "ru": ["Не удалось найти файл, поэтому создаётся новый.", "Не изменяйте сервер, пока с ним работает другая нить."],
}
LABELLED = langid.gathered([(k, t) for k, v in SAMPLES.items() for t in v])


@pytest.fixture(scope="module")
def model():
    return langid.Model(LABELLED)


def test_labels():
    for raw, want in {"en-US": "en", "ZH_Hans": "zh", "jp": "ja", "German": "de", "kr": "ko", "it": "other", "": None, " und ": None, None: None, "AUTO": None, "pt_BR": "pt", "N/A": None, "русский": "ru"}.items():
        assert langid.label(raw) == want, raw


def test_languages(model):
    for text, want in {"The server was not created.": "en", "Die Datei nicht ändern.": "de", "Le serveur est introuvable.": "fr", "请勿修改文件。": "zh", "サーバーを変更しないでください。": "ja", "Не изменяйте файл.": "ru"}.items():
        assert langid.judge(model.segments(text), None)[2] == [("missing", want)], text
    assert langid.judge(model.segments("The file was not found. Die Datei wurde nicht gefunden und wird neu angelegt."), "en")[2] == [("mixed", "de"), ("mixed", "en")]
    assert langid.judge(model.segments("Die Datei wurde nicht gefunden."), "en-GB")[2] == [("wrong", "de")]
    for wordless in (None, "", "  \n", "v2.1.0-rc1", "HTTP/2", "https://a.test/b", "{user_id}", "%s: %d", "😀😀", "ñññññ"):
        assert langid.judge(model.segments(wordless), None) == (None, 0.0, []), wordless
    assert langid.Model({}).segments("hello world again") == []


# -- p2 --------------------------------------------------------------------------------------


def test_defects(model):
    votes = pairs.Votes(LABELLED)
    ratios = {("en", "de"): 1.1, ("", "de"): 1.1, ("", "en"): 1.0}
    judge = lambda p, a, s="en", t="de": pairs.defect(p, a, s, t, ratios, model, votes)
    p = "The file was not found, so a new one is created. Do not change the server while another thread is using it."
    good = "Die Datei wurde nicht gefunden und wird deshalb neu angelegt. Den Server nicht ändern, solange ein anderer Thread darauf zugreift."
    assert judge(p, good) is None and judge(p, f"```\n{good}\n```") is None and judge(p, f"„{good}“") is None
    for a in (None, "", "``` ```", "“”", "​", "…"):
        assert judge(p, a) == "empty"
    assert judge(p, "I'm sorry, but I can't translate this text.") == "refusal"
    assert judge(p, "Es tut mir leid, diesen Text kann ich nicht übersetzen.") == "refusal"
    assert judge(p, p) == judge(p, f"Übersetzung: {p.upper()}") == "copy"
    assert judge(p, "Le fichier est introuvable, on en crée donc un nouveau. Ne modifiez pas le serveur tant qu'un autre fil l'utilise.") == "wrong_language"
    for cut in (40, 62, 90, len(good) - 6):
        assert judge(p, good[:cut]) == "truncated", cut
    assert judge("parse_page", "") is None and judge(None, "x") is None and judge(p, p, "de", "de") is None


# -- p3 --------------------------------------------------------------------------------------


def test_mojibake_round_trips():
    plain = "\n".join(t for v in SAMPLES.values() for t in v) * 2 + "áéíóúñçãõâêôàèùüöäßÁÉ" * 3
    p = mojibake.Plausibility(plain)
    wrong = 0
    for text, via, real in [
        ("Den Prozess nicht ändern, wir können öffnen.", "cp1252", "utf-8"), ("La conexión está aquí", "mac_roman", "utf-8"), ("Не изменяйте сервер", "cp1251", "utf-8"),
        ("Не удалось найти файл", "cp1251", "koi8_r"), ("找不到文件，因此会新建一个。", "latin-1", "gbk"), ("ファイルが見つからないため", "cp1252", "cp932"), ("Le fichier créé à", "cp437", "utf-8"),
    ]:
        try:
            bad = text.encode(real).decode(via)
        except UnicodeDecodeError:
            bad = text.encode(real).decode("latin-1")
        got = mojibake.examine(bad, p)
        assert got is not None, bad
        wrong += got[0] != text
    assert wrong <= 1
    twice = "für Größe".encode().decode("cp1252").encode().decode("cp1252")
    assert mojibake.examine(twice, p)[0] == "für Größe"
    part = "Wir können " + "öffnen".encode().decode("cp1252")
    assert mojibake.examine(part, p)[0] == "Wir können öffnen"
    assert mojibake.examine("a � b", p) == ("a � b", "", False)
    for fine in (None, "", "plain", "Ελληνικά μηνύματα", "Привіт, це їжак і ґанок.", "── menu ── ✓", "PÂTÉ, CRÈME BRÛLÉE", "半角ｶﾀｶﾅの入力", "«¿Qué?» ±5 µm © 2025", r"café &eacute;", "NÃO ALTERAR"):
        assert mojibake.examine(fine, p) is None, fine


# -- p7 --------------------------------------------------------------------------------------


def test_languages_in_code():
    m = codetext.Classes(langid.gathered([(k, t) for k, v in SAMPLES.items() for t in v * 3], 10_000, False), "x = y + 1;\nif (a > 3) return;\nconst a = b(c, 4);")
    found = lambda code, ext: sorted({k for _, k, _, _ in codetext.languages(code, ext, m)})
    assert found('# Die Datei wurde nicht gefunden.\nx = "The file was not found again."\n', "py") == ["de", "en"]
    assert found('// if (a > 3) return;\nf("SELECT id FROM jobs WHERE state = 1");\n// eslint-disable-next-line no-console\n', "js") == []
    assert found('f("\\u041d\\u0435 \\u0438\\u0437\\u043c\\u0435\\u043d\\u044f\\u0439\\u0442\\u0435 сервер, пока работает нить.")', "js") == ["ru"]
    assert found('<a title="Le fichier est introuvable, on en crée un." href="#x">The file was not found</a><!-- 找不到文件，因此会新建一个。 -->', "html") == ["fr", "zh"]
    assert found("RAISE NOTICE 'Le fichier n''est pas introuvable, on en crée donc.'; -- 请勿修改服务器。", "sql") == ["fr", "zh"]
    assert found(None, "py") == found("", None) == found("// " + "x" * 5000, "c") == []
    assert codetext.extract('a = "one " + "two"', "js")[0] == [("literal", "one two")]
    assert codetext.extract("# a\n# b\nx", "py")[0] == [("comment", "a\nb")]
    assert codetext.unescape(r"😀 \x41 \n") == "😀 A \n"


# -- p2 --------------------------------------------------------------------------------------


def test_names_of_languages_are_mapped_before_the_ratios(spark):
    from tests.conftest import _SPARK as spark

    rows = [("x" * 30, "y" * 60, s, t) for s, t in (("English", "русский"), ("en-US", "RU"), ("英语", "ru"), ("eng", "Russian"), ("en", "俄语"))]
    got = pairs.usual_ratios(spark.createDataFrame(rows, "original_text string, translated_text string, source_lang string, target_lang string"))
    assert got == {("en", "ru"): 2.0, ("", "ru"): 2.0}


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("ab c"), max_size=60), st.text(st.sampled_from("ab c"), max_size=60))
def test_copied_share(prompt, answer):
    least = min(12, len(answer))
    full = Automaton(prompt).coverage(answer, least) / max(1, len(answer))
    assert pairs.copied(prompt, answer) == (full if full >= pairs.COPIED else pytest.approx(0.0, abs=pairs.COPIED))


# -- p10 -------------------------------------------------------------------------------------


HARMFUL, HARMLESS = abuse_seed.texts(abuse_seed.HARMFUL), abuse_seed.texts(abuse_seed.HARMLESS)
PLAIN = [t for v in SAMPLES.values() for t in v] + abuse.random_words(50)


@pytest.fixture(scope="module")
def classifier():
    from tests.conftest import _SPARK as spark

    return abuse.classifier(spark, "/root/testdata/sf0.1")


def test_held_out_frames():
    """A quarter of the frames held out with all their texts, so whole predicates are new; with all plain clauses 65 % are found, 8 % false alarms."""
    def keep(held):
        return lambda frame: frame == "{}" or (zlib.crc32(frame.encode()) % 4 == 0) == held

    bad, good = ([t for t in abuse_seed.texts(b, keep=keep(True)) if t not in set(abuse_seed.texts(b, keep=keep(False)))] for b in (abuse_seed.HARMFUL, abuse_seed.HARMLESS))
    c = abuse.train(abuse_seed.texts(abuse_seed.HARMFUL, keep=keep(False)), abuse_seed.texts(abuse_seed.HARMLESS, keep=keep(False)), PLAIN, rounds=100)
    hits, alarms = (sum(z >= 0.5 for z in c.scores(t)) / len(t) for t in (bad, good))
    assert len(bad) > 300 and len(good) > 50 and hits > 0.45 and alarms < 0.2, (hits, alarms)


def test_disguises(classifier):
    for t in ("You f*cking idiot", "y.o.u i.d.i.o.t, k.i.l.l yourself", "YOU STUUUUPID IDIOOOOT", "yоu stupid idiоt", "you\u200b stupid\u200b idiot", "k1ll y0ur53lf", "your_stupid_idiot_go_to_hell", "Kill yourself! The file was not found. " * 2):
        assert classifier.score(t) >= 0.5, t
    for t in (None, "", "   ", "12345", "Kill the process and start it again.", "The word idiot is rejected in user names.", "x", "SELECT a FROM b", "`sex`", "The file was not found, so a new one is created."):
        assert classifier.score(t) < 0.5, t


def test_code_spans_and_masks_of_two_letters(classifier):
    for t in ("you are a `moron`", "You are a `MORON`.", "the `bitch`", "you b***h", "Show me your p***y"):
        assert classifier.score(t) >= 0.5, t
    assert classifier.score("The column `sex` holds the value.") < 0.5


def test_friendly_address_is_harmless(classifier):
    for t in ("you are a developer", "you are welcome", "watch your step", "Send it to you, then wait.", "If you are a `root` user, log out.", "remove the `moron` entry"):
        assert classifier.score(t) < 0.5, t


def test_scores_do_not_depend_on_the_batch_or_the_length(classifier):
    rng = random.Random(3)
    words = ["you", "idiot", "1diot", "k1ll", "12", "(3)", "#45,", "b-1-tch", "８", "№5", "`x_1`", "9!", "死ね", "\n", "kill 3 yourself", "傻逼", "the file. ", "\0", "\ud800", "e\u0301"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(200)] + [None, "", "\0"]
    alone = [classifier.score(t) for t in texts]
    assert alone == pytest.approx(classifier.scores(texts)) and texts.count(None) == 1 and alone[-3:] == [0.0, 0.0, 0.0]
    for t in ("you fucking idiot", "The file is closed."):
        long = "The file is closed.\n" * 150_000 + t
        assert classifier.score(long) == pytest.approx(max(classifier.score(t), classifier.score("The file is closed.")), abs=1e-3)


def test_sums_against_brute_force(classifier):
    """A segment's log odds are the sum over its n-grams, one by one."""
    for t in ("you stupid idiot", "你是白痴吗", "the file was not found"):
        s = " " + abuse.flat([t], classifier.words)[1:-1] + " "
        total = count = 0
        for n in abuse.ORDERS:
            for i in range(len(s) - n + 1):
                g = abuse.points(s[i : i + n])
                if n > 1 or abuse.no_blanks(g)[0]:
                    total += classifier.table[[at for k, at in abuse.hashes(g) if k == n][0][0]]
                    count += 1
        z = classifier.bias + total / math.sqrt(count + abuse.DAMPING)
        assert classifier.score(t) >= 1 / (1 + math.exp(-z)) - 1e-4


def test_training_without_one_class():
    assert abuse.train([], [], []).score("you idiot") == abuse.train([], ["a"], ["b"]).score(None) + abuse.train([], [], []).score("you idiot")
    assert abuse.train(["you idiot"], ["you idiot"], []).score("you idiot") < 0.5


def test_sentences_that_begin_like_directives_or_statements():
    for t in ("Define the retry limit first.", "Define o limite primeiro.", "Includes all open entries.", "Include the header of the file.", "Pragmatic choices are fine here.", "Select an entry from the list.", "select an entry from the list", "Update the set of workers.", "Insert into the list all new entries.", "Delete from the list what is old.", "Create or replace the file.", "Drop table entries that are old."):
        assert not codetext._DIRECTIVE.match(t) and not codetext._STATEMENT.match(t), t
    for t in ("include <stdio.h>", '#include "a.h"', "#define MAX_SIZE 10", "pragma: no cover", "pragma once", "sonar:off", "emacs: mode"):
        assert codetext._DIRECTIVE.match(t), t
    for t in ("SELECT id FROM jobs WHERE state = 1", "select id, name as n from users u where x", "select * from t", "select count(*) from a.b;", "Select id From jobs", "insert into t (a) values (1)", "update t set a = 1", "delete from t where a", "create table if not exists t (a int)", "drop table t;", "alter table t add c int"):
        assert codetext._STATEMENT.match(t), t


def test_a_language_needs_no_fixed_posterior():
    close = {"es": "x", "pt": "x", "code": "y"}
    c = object.__new__(codetext.Classes)
    c.names, c.prior, c.unseen, c.table, c.encode = sorted(close), [0.0] * 3, [0.0] * 3, {1: [0.4, 0.3, 0.2]}, lambda t: [1]
    assert c._best("x")[0] == "es"
    c.best = lambda line: ("es", 0.5)
    assert codetext.languages("# hay que probar esto\n", "py", c) == [("comment", "es", 16, 0.5)]


def test_damage_in_many_layers_and_escapes():
    p = mojibake.Plausibility("Die Datei wurde nicht gefunden, größer als möglich. Не меняйте файл, пока работает поток. ファイルが見つかりません。日本語 " * 3)
    text = "größer als möglich für"
    for _ in range(5):  # more layers than any fixed depth
        text = text.encode().decode("latin-1")
    got = mojibake.examine(text, p)
    assert got and got[0] == "größer als möglich für" and len(got[1].split()) == 5
    iso = "日本語".encode("iso2022_jp").decode("ascii")
    assert mojibake.examine("// " + iso, p)[0] == "// 日本語" and mojibake.examine("// " + iso.replace("\x1b", ""), p)[0] == "// 日本語"
    assert mojibake.examine("gr=C3=B6=C3=9Fer", p)[0] == "größer"
    for right in ("a=10=20", "\x1b[31mred\x1b[0m", "x = $B(1)", "color=FF=00", "größer"):
        assert mojibake.examine(right, p) is None, right
