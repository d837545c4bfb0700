"""Analytics over long stream recordings and the libraries built from them."""
