"""What the rule of op7_sentence_spans leaves: runs of over 50 words that another text holds too."""

import pyarrow.parquet as pq

from tests.conftest import SMALL
from watchtide.llm.sentence_spans import SENTENCES, WORDS, run_hashes, sentences

LONG, DISTINCT = 51, 20  # words of a run, and how many of them differ


def after_the_rule(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        gone = set()
        for at, (h, n) in enumerate(zip(*run_hashes(text, SENTENCES, WORDS))):
            gone |= set(range(at, at + n)) if h in seen else set()
            seen.add(h)
        out[i] = "".join(s for n, s in enumerate(sentences(text)) if n not in gone)
    return out


def sharing(texts):
    """Ids of texts that share a long run with another."""
    owner, found = {}, set()
    for i, text in texts.items():
        parts = text.split()
        for at in range(len(parts) - LONG + 1):
            run = parts[at:at + LONG]
            if len(set(run)) >= DISTINCT:
                first = owner.setdefault(hash(tuple(run)), i)
                found |= {first, i} if first != i else set()
    return found


def test_leftover_is_what_the_readme_says():
    table = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = [(r["doc_id"], r["text"] or "") for r in table]
    before, after = sharing(dict(rows)), sharing(after_the_rule(rows))
    assert (len(before), len(after)) == (38, 6)
