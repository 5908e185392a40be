"""DataFrame operators: segmentation, packing, chunking, inference, state, retrieval."""
