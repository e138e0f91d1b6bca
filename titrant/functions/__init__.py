"""Part of titrant."""
