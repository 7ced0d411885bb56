"""Common given names by script and gender."""

from __future__ import annotations

_LISTS = {
    ("latin", "f"): "Aisha Amina Ananya Anjali Chiara Deepika Giulia Ines Jana Jelena Katarzyna Kavita Lena Leila Magdalena Mei Mercedes Meera Milena Nadine Nisha Noor Pooja Priya Rania Sakura Shreya Sunita Svetlana Yasmin Yuki Zara Zeynep Abigail Adriana Agnieszka Alejandra Alexandra Alice Amelia Amy Anastasia Andrea Angela Anna Anne Antonia Audrey Barbara Beatrice Birgit Camille Carla Carmen "
    "Caroline Catherine Cecilia Charlotte Chloe Christina Clara Claudia Daniela Deborah Diana Dorothy Eleanor Elena Elizabeth Ellen Emily Emma Esther Eva Evelyn Fatima Fiona "
    "Florence Francesca Franziska Gabriela Greta Hannah Heather Heidi Helen Helena Ingrid Irene Isabel Isabella Jacqueline Jane Janet Jennifer Jessica Joanna Johanna Josefina "
    "Judith Julia Juliette Karen Katharina Katherine Kathleen Kimberly Kristina Laura Leonie Linda Lisa Louise Lucia Manon Margaret Maria Marie Marina Martha Martina Mary Megan "
    "Melissa Michelle Monica Monika Nadia Natalia Nicole Nina Olivia Pamela Patricia Paula Petra Pilar Rachel Rebecca Renate Rosa Rosalind Ruth Sabine Samantha Sandra Sarah "
    "Sharon Silvia Simone Sofia Sophie Stephanie Susan Susanne Sylvie Teresa Ursula Valentina Valeria Vanessa Veronica Victoria Virginia Wanda Ximena Yvonne",
    ("latin", "m"): "Abdul Ahmed Ali Amit Anil Arjun Arturo Bilal Bogdan Carlo Dmitri Enzo Giovanni Goran Hassan Hiroshi Hussein Ibrahim Igor Ivan Jan Jiro Kenji Krishna Luca Marek Mehmet Mohammed Murat Mustafa Nikolai Omar Piotr Rahul Raj Rajesh Ravi Sanjay Sergei Stanislav Suresh Takeshi Tariq Tomasz Vijay Vikram Wei Yusuf Aaron Adam Adrian Alan Alejandro Alexander Alfonso Andreas Andrew Anthony Antoine Antonio Arthur Benjamin Bernard Brian Bruno Carlos Charles Christian "
    "Christopher Claude Daniel David Dennis Diego Dieter Dominic Donald Douglas Edward Emilio Enrique Eric Ernesto Eugene Felipe Felix Fernando Francisco Franz Frederick Gabriel "
    "Gary Geoffrey George Gerald Gerhard Guillaume Gustavo Hans Harold Heinrich Henri Henry Hugo Ignacio Isaac Jack Jacob Jacques James Javier Jeffrey Jens Jeremy Jerome John "
    "Jonathan Jorge Joseph Joshua Juan Julian Justin Karl Kenneth Kevin Klaus Kurt Laurent Lawrence Leonard Lorenzo Louis Lucas Luis Manuel Marcel Marco Mario Martin Matthew "
    "Matthias Maurice Maximilian Michael Miguel Nathan Nicholas Nicolas Norbert Oliver Oscar Otto Pablo Patrick Paul Pedro Peter Philip Philippe Pierre Rafael Ralph Raymond Ricardo "
    "Richard Robert Roberto Roger Roland Ronald Rudolf Russell Samuel Santiago Scott Sebastian Sergio Simon Stefan Stephen Steven Theodore Thomas Timothy Tobias Ulrich Victor "
    "Vincent Walter William Wolfgang Xavier Yves",
    ("cyrillic", "f"): "Анастасия Анна Валентина Вера Виктория Галина Дарья Евгения Екатерина Елена Зоя Ирина Ксения Лариса Людмила Марина Мария Надежда Наталья Ольга Светлана София Тамара Татьяна Юлия",
    ("cyrillic", "m"): "Александр Алексей Анатолий Андрей Борис Вадим Валерий Василий Виктор Владимир Геннадий Григорий Дмитрий Евгений Иван Игорь Константин Михаил Николай Олег Павел Пётр Роман Сергей Юрий",
    ("greek", "f"): "Αικατερίνη Αλεξάνδρα Βασιλική Γεωργία Δήμητρα Ειρήνη Ελένη Ευαγγελία Ιωάννα Κωνσταντίνα Μαρία Παναγιώτα Σοφία",
    ("greek", "m"): "Αλέξανδρος Ανδρέας Αντώνιος Βασίλειος Γεώργιος Δημήτριος Εμμανουήλ Ιωάννης Κωνσταντίνος Μιχαήλ Νικόλαος Παναγιώτης Χρήστος",
}
BY_KIND: dict[tuple[str, str], list[str]] = {k: v.split() for k, v in _LISTS.items()}
#: name -> (script, gender)
GIVEN: dict[str, tuple[str, str]] = {n: k for k, names in BY_KIND.items() for n in names}
