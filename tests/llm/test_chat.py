"""Chat formatting: round trips of hostile texts, and masks."""

import hashlib
import random

import public_tokenizers

from marlstone.llm import chat

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_escape_round_trip():
    random.seed(2)
    for _ in range(3000):
        turns = [("".join(random.choice("<\\|ab>turnsayover ") for _ in range(random.randint(0, 8))), "".join(random.choice(["<", "\\", "|", ">", "é日 \n", "<|turn|>", "<|over|>"]) for _ in range(random.randint(0, 14)))) for _ in range(3)]
        assert chat.parse(chat.render(turns)[0]) == turns


def test_tokens_hold_the_text(spark):
    codec = chat.codec(PATH)
    for text in ("  two\n\n spaces ", "日本é́", "<\\|endoftext|>", ""):
        rendered, _ = chat.render([("user", text), ("assistant", text)])
        assert codec.decode(codec.library.encode(rendered, add_special_tokens=False).ids) == rendered


def test_encoding_is_the_librarys():
    """Ids and offsets of hostile and foreign texts, against the library's."""
    random.seed(11)
    tok = chat.codec(PATH)
    parts = ["the", "don't", "it's", "'ll", " ", "  ", "\n", "\t \n", "12", "7", "_", "é", "Straße", "naïve", "日本", "😀", "|", "<", "\\", "!?", "…", "\u00a0", "²", "x" * 30, "<|turn|>", "<|says|>", "<|over|>", "ĳ", "’s"]
    for n in range(4000):
        text = "".join(random.choice(parts[:12] if n % 2 else parts) for _ in range(random.randint(0, 14)))
        want = tok.library.encode(text, add_special_tokens=False)
        ids = tok.encode(text)
        assert ids.tolist() == want.ids, text
        assert tok.starts(ids).tolist() == [o[0] for o in want.offsets], text
        assert tok.decode(ids) == text


def test_masks_are_the_texts(spark):
    turns = [("user", "Wie groß <|x|> ist 日本?"), ("assistant", "Sehr groß 😀\n"), ("assistant", ""), ("tool", "a"), ("assistant", " x<|over|>")]
    df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    (row,) = chat.format_chat(df, PATH).collect()
    tok = chat.codec(PATH)
    learned = [i for i, keep in zip(row["ids"], row["loss"]) if keep]
    assert tok.decode(learned) == "".join(chat.escape(t) for r, t in turns if r == "assistant") and row["formatted"] == chat.render(turns)[0]


def test_read_back(spark):
    rows = [(1, 1, "assistant", " <|over|>\t<|endoftext|>  \n"), (1, 0, None, None), (1, 2, "assistant", "<\\|x"), (None, 0, "user", "a"), (None, 0, "user", "a"), (2, None, "assistant", "日本é"), (2, 5, "assistant", ""), (-7, 0, "user", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, loss string")
    found = chat.read_back(chat.format_chat(df, PATH), PATH).collect()
    assert len(found) == 5
    for r in found:
        if r["conv_id"] is None:
            turns = [("user", "a")]
        else:
            turns = [(role or "", text or "") for c, t, role, text in sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: (x[1] is not None, x[1] or 0))]
        learned = "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_chars"] == len(learned) and r["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
        assert r["formatted_chars"] == len(chat.render(turns)[0])


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_chat(df, PATH), PATH).count() == 0
