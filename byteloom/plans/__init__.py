"""Driver loops over DataFrames: training, training by chunks."""
