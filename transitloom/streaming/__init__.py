"""An incremental mode over the batch operators."""
