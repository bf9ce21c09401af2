"""Raw texts to typed rows."""
