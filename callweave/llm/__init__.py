"""Training-data operators: ten numbered operators over documents, embeddings and conversations."""
