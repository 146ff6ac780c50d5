"""Reports and files made from small results."""
