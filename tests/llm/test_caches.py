from pagemill.llm import language, sentencepieces
from pagemill.llm.jobs import PIECES


def model():
    return language.fit([("en", ["the", "house", "of", "them"]), ("de", ["das", "haus", "und", "wir"])] * 4)


def test_a_worker_holds_the_caches_of_one_operator():
    """The stages of the pipeline run in the same worker processes, one after another."""
    first, text = model(), "the house und das haus"
    before = first.predict([text])
    assert first.cache and language._HASHES
    encoded = sentencepieces.encoder(PIECES).encode(text)
    assert not first.cache and first.table is None and not language._HASHES
    assert sentencepieces.encoder(PIECES).words
    second = model()
    assert second.predict([text]) == before
    assert not sentencepieces._ENCODERS
    assert first.predict([text]) == before and not second.cache
    assert sentencepieces.encoder(PIECES).encode(text) == encoded
