"""Small neural networks: arrays with gradients on the driver, and full-batch gradients summed by Spark."""
