"""Layout and text analytics over corpora of documents, as DataFrame operators."""
