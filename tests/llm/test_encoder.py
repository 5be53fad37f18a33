"""Words with signs behind them are put together without the pattern for lines."""

from public_tokenizers import path

from labelspring.llm import bpe


def test_signs_behind_a_word_take_the_short_way(monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = ["the end. And, (so) on!! été... l'eau, a_b_ x9. 9. don't. ß&&& İ? it's-", " . ,a. b", "one.\ntwo, three", ""]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = bpe.Encoder(path("byte_bpe_50k.json"))
    assert [list(memoryview(encoder.encode(t)).cast("I")) for t in texts] == want
    monkeypatch.setattr(bpe, "_PIECES", None)
    again = bpe.Encoder(path("byte_bpe_50k.json"))
    short = "the end. And, so on!! été... a_ ß&&& İ?"
    assert list(memoryview(again.encode(short)).cast("I")) == library.encode(short, add_special_tokens=False).ids


def test_forgotten_words_give_the_same_ids():
    encoder = bpe.Encoder(path("byte_bpe_50k.json"))
    text = "a one two three. four, one two five six. one"
    want = encoder.encode(text)
    encoder.parts.kept = 2
    encoder.parts.clear()
    assert encoder.encode(text) == want and len(encoder.parts) <= 2
