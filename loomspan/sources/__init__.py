"""Where rows come from: datasets with splits, Arrow shards, configurations."""
