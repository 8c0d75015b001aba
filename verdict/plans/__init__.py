"""Plans: named lists of steps that a message runs through."""
