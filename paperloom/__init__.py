"""paperloom: originality analytics over paper corpora, as Spark dataflow."""
