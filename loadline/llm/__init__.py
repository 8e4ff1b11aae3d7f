"""Training-data operators: line and near-duplicate removal, decontamination, vector search,
chat formatting, packing, toxicity, language-model scoring, HTML extraction and sharding."""
