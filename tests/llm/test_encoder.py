"""The encoder has a special token to look for, and its string is ordinary text."""

from tokenizers import Tokenizer

from carelake.llm import packing, tokens


def test_the_unused_token_is_text_like_any_other():
    raw = packing.read_ranks(packing.RANKS)
    encoding, size = tokens._encoder(raw)
    assert encoding.special_tokens_set == {tokens.NO_TOKEN} and encoding.max_token_value == len(size)
    own = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    own.encode_special_tokens = True
    for text in (tokens.NO_TOKEN, f"a {tokens.NO_TOKEN}b", "\x00", "é <|endoftext|>\n", ""):
        assert packing.encode(raw, text).tolist() == own.encode(text, add_special_tokens=False).ids
