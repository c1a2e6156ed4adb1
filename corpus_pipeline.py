"""The corpus pipeline: five stages, each one operator of ``millrace.llm`` over all documents
that the stage before it kept.  A stage's result is written as Parquet and read by the next."""

from millrace.llm import decontaminate, line_dedup, mixing, quality_classifier, simhash
from millrace.llm.text import written
from millrace.session import scratch


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark, docs, sf_dir):
    """Documents that the classifier, trained on the given labels, does not reject."""
    return quality_classifier.keep_good(docs, _table(spark, sf_dir, "labels"))


def without_repeated_lines(spark, docs, sf_dir):
    """All documents, without the lines that others repeat."""
    return line_dedup.shorten(docs)


def one_of_near_copies(spark, docs, sf_dir):
    """The document of the smallest doc_id of each group whose fingerprints, over four-word
    shingles, are linked by four or fewer differing bits."""
    return simhash.keep_one(docs, simhash.near_components(docs))


def without_benchmark(spark, docs, sf_dir):
    """Documents that hold no test string of the benchmark."""
    return decontaminate.keep_clean(docs, _table(spark, sf_dir, "benchmark"))


def mixed(spark, docs, sf_dir):
    """Documents of the mix with the number of copies and words the mix takes of each."""
    return mixing.mixed_corpus(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("simhash near-dedup", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("source mix", mixed),
]

# Training and near copies cannot be put in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, spent = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as tables:
            kept = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        # What the stage worked with is not needed any more, nor what it read.
        tables.remove(but=kept)
        if spent is not None:
            spent.remove()
        docs, spent = kept, tables
    return STAGES[-1][1](spark, docs, sf_dir)
