"""Token counts by a linear longest-match automaton over a word-piece vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame

from voxelmill.llm.common import slices, text_of

#: Stands before each word, as in the vocabulary's word-initial pieces.
MARK = "▁"
#: Words whose counts a task remembers at most; then it forgets all.
MEMORY = 200_000


class Automaton:
    """Greedy longest-match piece counts in one pass over a word.

    A trie over the vocabulary, where each node has a failure link (the node of
    what is left after the longest-match pieces of its text are popped) and the
    number of pieces popped on the way.  Characters that are no piece count as
    their UTF-8 bytes (byte fallback), so every text has a count.
    """

    def __init__(self, vocabulary):
        nodes, child, char, parent, final = 1, {}, [""], [-1], [0]
        for piece in vocabulary:
            at = 0
            for c in piece:
                key = (at, c)
                if key not in child:
                    child[key] = nodes
                    char.append(c)
                    parent.append(at)
                    final.append(0)
                    nodes += 1
                at = child[key]
            if at:
                final[at] = 1
        for key, node in list(child.items()):
            if key[0] == 0 and not final[node]:
                final[node] = len(key[1].encode("utf-8", "surrogatepass"))
        # a character that only continues pieces: it needs a first-level node too
        for c in {c for _, c in child} - {c for at, c in child if at == 0}:
            child[0, c] = nodes
            char.append(c)
            parent.append(0)
            final.append(len(c.encode("utf-8", "surrogatepass")))
            nodes += 1
        fail, popped = [0] * nodes, [0] * nodes
        level = [v for (at, _), v in child.items() if at == 0]
        below: dict[int, list[int]] = {}
        for (at, _), v in child.items():
            below.setdefault(at, []).append(v)
        while level:
            for v in level:
                if final[v]:
                    fail[v], popped[v] = 0, final[v]
                else:
                    z, n = fail[parent[v]], popped[parent[v]]
                    while (z, char[v]) not in child:
                        n += popped[z]
                        z = fail[z]
                    fail[v], popped[v] = child[z, char[v]], n
            level = [x for v in level for x in below.get(v, ())]
        self.child, self.fail, self.popped = child, fail, popped

    def count(self, text: str) -> int:
        child, fail, popped = self.child, self.fail, self.popped
        at = n = 0
        for c in text:
            while (nxt := child.get((at, c))) is None:
                if not at:
                    n += len(c.encode("utf-8", "surrogatepass"))
                    break
                n += popped[at]
                at = fail[at]
            else:
                at = nxt
        while at:
            n += popped[at]
            at = fail[at]
        return n


def read_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model file (no control, unknown or byte pieces)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


def count_tokens(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, n_words, n_tokens.

    Words are runs of other than ASCII white space; each is MARK plus the word,
    cut greedily into the longest pieces.  Null and wordless texts count 0;
    repeated rows get equal counts; an empty table gives no rows.  The vocabulary
    is of fixed size and broadcast once.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(list(vocabulary))

    def run(batches):
        import pyarrow as pa

        auto, memory = Automaton(pieces.value), {}
        for part in slices(batches):
            words, toks = [], []
            for t in part.column(1).to_pylist():
                n = 0
                split = t.encode("utf-8", "surrogatepass").split()
                for w in split:
                    k = memory.get(w)
                    if k is None:
                        if len(memory) >= MEMORY:
                            memory.clear()
                        k = auto.count(MARK + w.decode("utf-8", "surrogatepass"))
                        if len(w) <= 64:
                            memory[w] = k
                    n += k
                words.append(len(split))
                toks.append(n)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.int64()), pa.array(toks, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")
