"""Training-data operators over the tables documents, embeddings, pages, benchmark, labels and conversations."""
