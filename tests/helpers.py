"""What several test modules share."""

DATA = "/root/testdata/sf0.001"


def same_rows(frame, relation) -> None:
    """The rows and column names of a DataFrame and a DuckDB relation are equal, whatever their order."""
    assert sorted(frame.columns) == sorted(relation.columns)
    left, right = ([tuple(r[i] for i in sorted(range(len(names)), key=lambda i: names[i])) for r in rows] for names, rows in ((frame.columns, frame.collect()), (relation.columns, relation.fetchall())))
    assert sorted(map(repr, left)) == sorted(map(repr, right))


class LabelBackend:
    """Vectors made of a text's label and words, so that what a gate has to see can be put in on purpose.

    ``labels`` gives the label of each text; the first dimensions say which one
    it is, the rest count words. ``spoil`` changes the list of vectors of a call
    before it is returned, or raises.
    """

    name = "labels"

    def __init__(self, labels, dims=64, spoil=None):
        self.labels, self.dims, self.spoil = labels, dims, spoil
        self.known = sorted(set(labels.values()))

    def embed(self, texts):
        vectors = []
        for text in texts:
            own = [0.0] * self.dims
            for label, name in ((v, k) for k, v in self.labels.items()):
                if text.endswith(name):
                    own[self.known.index(label)] += 4.0
            for word in text.split():
                own[len(self.known) + sum(word.encode()) % (self.dims - len(self.known))] += 1.0
            size = sum(x * x for x in own) ** 0.5
            vectors.append([x / size for x in own])
        return self.spoil(vectors) if self.spoil else vectors

    def describe(self):
        return {"name": self.name}


def refuse(vectors):
    raise ConnectionError("nobody listens")


#: What may go wrong with the vectors of a call.
SPOILS = {
    "alternating": lambda vectors: [[1.0 if i == k % 7 else 0.01 * (k + 1) for i in range(len(v))] for k, v in enumerate(vectors)],
    "one point": lambda vectors: [vectors[0]] * len(vectors),
    "nothing": lambda vectors: [[0.0] * len(v) for v in vectors],
    "first one lost": lambda vectors: vectors[1:],
    "refused": refuse,
}
