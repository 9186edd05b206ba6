"""Lists, bags, maps, grids, products and what is done with them."""
