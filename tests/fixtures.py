"""Fixed test inputs and goldens (values from the reference's saved
artefacts and test scripts; see FIXTURES.md)."""

NAN = None

# cleaning fixture: 12 rows, then rows 0 and 1 appended again
CLEAN_ROWS = [
    (1, 25.0, 50000, 1, NAN, "A", 0), (2, 30.0, 60000, 1, NAN, "B", 1), (3, NAN, 70000, 1, NAN, NAN, 0),
    (4, 45.0, 80000, 1, NAN, "A", 1), (5, 50.0, 90000, 1, NAN, "B", 0), (6, 25.0, 50000, 1, NAN, "A", 0),
    (7, 30.0, 60000, 1, NAN, "B", 1), (8, 35.0, 70000, 1, "value", "A", 0), (9, 40.0, 80000, 1, NAN, "B", 1),
    (10, 45.0, 90000, 1, NAN, "A", 0), (11, 50.0, 100000, 1, NAN, NAN, 1), (12, NAN, 110000, 1, NAN, "B", 1),
    (1, 25.0, 50000, 1, NAN, "A", 0), (2, 30.0, 60000, 1, NAN, "B", 1),
]
CLEAN_SCHEMA = ("id long, age double, income long, constant_col long, mostly_missing string, category string, "
                "target long")

SIMPLE_ROWS = [(1, 25.0, 50000, 1, 0), (2, 30.0, 60000, 1, 1), (3, NAN, 70000, 1, 0), (4, 45.0, 80000, 1, 1),
               (5, 50.0, 90000, 1, 0)]
SIMPLE_SCHEMA = "id long, age double, income long, constant_col long, target long"

# stored CV leaderboard of the demo project: (model, f1_mean, f1_std, training_time, overfitting)
CV_BOARD = [
    ("Gradient Boosting", 0.9110653574328559, 0.004667633340340056, 16.958635568618774, 0.033354922279792865),
    ("XGBoost", 0.9064544040194222, 0.0019084361258809971, 1.1073875427246094, 0.0906088082901555),
    ("LightGBM", 0.9056036177143583, 0.004301728217967416, 1.246581792831421, 0.08983160621761654),
    ("Naive Bayes", 0.9046353520140737, 0.009418725600920497, 0.1306595802307129, 0.002655440414507937),
    ("Random Forest", 0.8996839765093396, 0.004126817589753574, 3.4375193119049072, 0.09378238341968903),
    ("Decision Tree", 0.8906520731958727, 0.0036424360533533393, 0.16012978553771973, 0.10893782383419681),
    ("AdaBoost", 0.8847038900555404, 0.015760709762493764, 6.256423473358154, 0.0013601036269430544),
    ("Extra Trees", 0.8459696985931446, 0.002508744904501108, 2.9291510581970215, 0.13652849740932638),
    ("Support Vector Machine", 0.8246897811710744, 0.008370457605226728, 39.7730176448822, 0.029112694300518216),
    ("K-Nearest Neighbors", 0.7416212572883151, 0.008421266969275209, 0.3605630397796631, 0.04258419689119153),
    ("Logistic Regression", 0.6907545032045643, 0.0025461285571764802, 0.41468143463134766, 0.0011658031088083165),
]
# golden composite scores, priority "balanced"
BALANCED = {"Naive Bayes": 0.948414, "Decision Tree": 0.873691, "Random Forest": 0.852245, "XGBoost": 0.845543,
            "LightGBM": 0.841080, "Gradient Boosting": 0.818875, "AdaBoost": 0.807781, "Extra Trees": 0.738256,
            "K-Nearest Neighbors": 0.622573, "Support Vector Machine": 0.609805, "Logistic Regression": 0.580890}
PRIORITY_WINNERS = {"performance": ("Gradient Boosting", 0.976347), "speed": ("Naive Bayes", 0.974892),
                    "interpretability": ("Naive Bayes", 0.906206), "stable": ("Naive Bayes", 0.959324),
                    "balanced": ("Naive Bayes", 0.948414)}

# stored hold-out predictions: confusion counts (actual, predicted, n)
CONFUSION = [(0, 0, 1456), (1, 1, 52), (1, 2, 129), (2, 1, 56), (2, 2, 238)]
STORED_ACCURACY = 0.9041947177628172
STORED_PRECISION = 0.89788065701352
STORED_F1 = 0.8973850494809518

# feature-preparation sample
PREP_ROWS = [(25, 50000, "M", "NYC", 0), (30, 60000, "F", "LA", 1), (35, 75000, "M", "Chicago", 1),
             (40, 80000, "F", "NYC", 0), (45, 90000, "M", "LA", 1)]
PREP_SCHEMA = "age long, income long, gender string, city string, purchased long"

# routing questions and their expected routes
QUESTIONS = {
    "lime": ["Explain with LIME", "Give me an alternative explanation", "Another way to explain this prediction?"],
    "local": ["Why did the model predict this?", "Explain the prediction", "What was the result?",
              "How does the model predict?", "What is the feature impact for this prediction?",
              "Feature weights for this prediction?"],
    "global": ["What features matter?", "Which features drive the model?", "Top features?",
               "What's overall importance?"],
    "impact": ["SHAP values?", "What are the contributions?"],
    "performance": ["How good is the model?", "What's the performance?", "Accuracy?", "Precision and recall?"],
    "limitations": ["What are the limitations?", "Can I trust this model?", "What are the caveats?",
                    "Does it generalize?"],
    "default": ["Hello", "Tell me something"],
}
