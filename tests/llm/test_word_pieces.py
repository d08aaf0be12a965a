"""Words of one head are encoded once, whatever their case and marks, and pieces are no words."""

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from procgraph.llm.token_ids import WordEncoder, vocabulary_path


class Counted:
    def __init__(self, model):
        self.model, self.asked = model, []

    def tokenize(self, text):
        self.asked.append(text)
        return self.model.tokenize(text)


def ids_of(encode, texts):
    data, ends = encode(pa.array(texts, pa.large_string()))
    return [x.tolist() for x in np.split(np.frombuffer(data, "<u4"), ends[1:-1])]


def test_heads_once():
    path = vocabulary_path("word_bpe_49k.json")
    encode, whole = WordEncoder(path), Tokenizer.from_file(path)
    encode.model = Counted(encode.model)
    for texts in (["zebraic '", "it's '! ZEBRAIC, x'"], ["Zebraic. zebraic! '! ',", "lions" + "." * 12 + " ' _m m_"], [""]):
        assert ids_of(encode, texts) == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert encode.model.asked.count("zebraic") == 1
