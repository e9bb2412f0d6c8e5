"""New words with a space in front come straight from the model's merges, with the library's ids."""

from lexisieve.llm import encoding


def test_spaced_words_have_the_library_s_ids(monkeypatch):
    encoder = encoding.WordEncoder(encoding.BYTE_BPE)
    letters = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x250)) if c not in (0xD7, 0xF7)]
    words = [" " + "".join(letters[i:i + 1 + i % 9]) for i in range(len(letters))]
    expected = [encoder._whole(w) for w in words]
    monkeypatch.setattr(encoder, "_whole", None)  # asked for no word
    assert encoder.encode(words) == expected
